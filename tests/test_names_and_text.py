import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.functions import text as X
from lacuna.functions.names import canonical_key, canonical_label, key_column, label_column

LABELS = [None, "", "  ", "JWT [METHOD]", "jwt  [ tool ] [Concept]", "[METHOD]", "a [other]", "Straße [Tool]\n", "ｆｕｌｌ　width [ＴＯＯＬ]", "x]", "A\x1cB\tC", "Tywagumié gateway  [ CONCEPT ]", "[tool] b", "b[tool]", "ﬁne", "K [METHOD]"]


def definition(value):
    label, before = unicodedata.normalize("NFKC", value or ""), None
    while label != before:
        before = label
        label = re.sub(r"\s*\[\s*(?:method|dataset|metric|concept|finding|tool|unknown)\s*\]\s*$", "", label, flags=re.IGNORECASE)
    return re.sub(r"\s+", " ", label).strip()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aKé [](]\t\n toolTOOLmetric　ſİı", max_size=40))
def test_label_definition(value):
    assert canonical_label(value) == definition(value)
    assert canonical_key(value) == definition(value).casefold()


def test_columns_agree_with_the_functions(spark):
    rows = spark.createDataFrame([(v,) for v in LABELS], "v string").select("v", label_column(F.col("v")).alias("l"), key_column(F.col("v")).alias("k")).collect()
    for r in rows:
        want = (None, None) if r["v"] is None else (definition(r["v"]), definition(r["v"]).casefold())
        assert (r["l"], r["k"]) == want, r


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_tokens_and_specificity(spark):
    assert set(one(spark, "OAuth2 and the JWT-3 4", X.tokens(F.col("x")))[0]) == {"oauth2", "oauth", "jwt", "3", "4"}
    assert one(spark, None, X.tokens(F.col("x")))[0] is None
    low = one(spark, "x", X.specificity(F.array(F.lit("our method"))), X.specificity(F.array().cast("array<string>")), X.specificity(F.array(F.lit("zero trust service mesh"))))
    assert low[0] == 0 and low[1] == 0 and low[2] == 1.0
    assert one(spark, "x", X.specificity(F.array(F.lit("graph model"))))[0] == 0.75 * 0.5 + 0.25 * 2 / 3


def test_chunk_words(spark):
    words = " ".join(f"w{i}" for i in range(25))
    out = one(spark, words, X.chunk_words(F.col("x"), 10, 3))[0]
    assert [c.split()[0] for c in out] == ["w0", "w7", "w14", "w21"] and out[-1] == "w21 w22 w23 w24"
    assert one(spark, None, X.chunk_words(F.col("x"), 10, 3))[0] == [] and one(spark, "  ", X.chunk_words(F.col("x"), 10, 3))[0] == []


def test_small_parsers(spark):
    assert abs(one(spark, "6m12.038s", X.duration_seconds(F.col("x")))[0] - 372.038) < 1e-9
    assert one(spark, "4.9s", X.duration_seconds(F.col("x")))[0] == 4.9 and one(spark, "soon", X.duration_seconds(F.col("x")))[0] is None
    years = [(v, one(spark, v, X.strict_year(F.col("x")))[0]) for v in ("2020", " 2020 ", "2020.0", "", None, "n.d.")]
    assert [y for _, y in years] == [2020, 2020, None, None, None, None]
    assert one(spark, "2026-07-20", X.year_of_date(F.col("x")))[0] == 2026 and one(spark, "x", X.year_of_date(F.col("x")))[0] == 0
    answer = "GAP: no data\nEVIDENCE: two\nlines\nMETHOD: try"
    got = one(spark, answer, *[X.extract_field(F.col("x"), f, ("GAP", "EVIDENCE", "METHOD", "IMPACT")) for f in ("GAP", "EVIDENCE", "METHOD", "IMPACT")])
    assert list(got) == ["no data", "two\nlines", "try", ""]
    assert one(spark, "0", X.truthy(F.col("x")))[0] is None and one(spark, " ", X.truthy(F.col("x")))[0] == " "


def test_similarity():
    assert X.indel_ratio("", "") == 100 and X.indel_ratio("abc", "") == 0
    assert X.indel_ratio("kitten", "sitting") == 100 * 2 * 4 / 13
    assert X.sort_key("Mesh, Service!") == "mesh service"


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_indel_ratio_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 100 * 2 * table[-1][-1] / (len(a) + len(b)) if a or b else 100
    assert abs(X.indel_ratio(a, b) - want) < 1e-9
