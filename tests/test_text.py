"""Text functions against plain Python versions written from their definitions, over edge strings."""

import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import features as X
from tidemill.functions import text as T
from tidemill import queries as core
from tidemill.functions.wordpiece import pooled, wordpiece
from tidemill.vocabulary import FAMILIES, KEYWORDS, KNOWN_TLDS

EDGE = ["café n° İstanbul", "a b", "你好 abc", "x́y", "😀 ok", "٣٤", "12²", "a\u0085b c", "ß ẞ", "Ⅸ", "see you tomorrow.We can", "3.50", "bit.ly/x", "HTTP://1.2.3.4", "www.Foo.com.", ":)", "http://only.example.com/a?b", "12345", "", None, "M3dicare URGENT!! verify your usps.com-parcel.top/x", "x" * 5000]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


def py_clean(s):
    s = (s or "").replace(" ", " ")
    s = "".join(c for c in s if c in "\t\r\n" or c >= " ")
    return re.sub(r"\s+", " ", s).strip()


def test_clean_matches_python(spark):
    got = [r[0] for r in frame(spark, EDGE).orderBy("i").select(T.clean(F.col("text"))).collect()]
    assert got == [py_clean(v) for v in EDGE]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"), exclude_characters="\x00"), max_size=40), min_size=20, max_size=20))
def test_clean_property(spark, values):
    got = [r[0] for r in frame(spark, values).orderBy("i").select(T.clean(F.col("text"))).collect()]
    assert got == [py_clean(v) for v in values]


def test_template_key(spark):
    values = ["Pay £12.50 at http://a.example/x now", "PAY £99 at www.b.example/yy now!", ":)", ".", "http://a.example/1", "www.b.example", "12", "foo bar.com/x baz"]
    k = [r[0] for r in frame(spark, values).orderBy("i").select(T.template_key(F.col("text"))).collect()]
    assert k[0] == "pay numtoken numtoken at urltoken now" and k[1] == "pay numtoken at urltoken now"
    assert k[2] == "=:)" and k[3] == "=." and k[4] != k[5] and k[6] == "=12" and k[7] == "foo urltoken baz"


def test_domains(spark):
    values = ["tomorrow.We can", "3.50", "bit.ly/x", "http://Foo.Weird/x", "www.Foo.com.", "a@b.com"]
    got = [r[0] for r in frame(spark, values).orderBy("i").select(T.domains(F.col("text"), KNOWN_TLDS)).collect()]
    assert got == [[], [], ["bit.ly"], ["foo.weird"], ["foo.com"], ["b.com"]]


def test_features_of_edges(spark):
    rows = X.with_keywords(X.with_features(frame(spark, EDGE))).orderBy("i").collect()
    for r, v in zip(rows, EDGE):
        t = v or ""
        assert r["length"] == len(t) and r["n_exclaim"] == t.count("!")
        low = t.lower()
        for fam, terms in FAMILIES.items():
            assert r[f"{fam}_n"] == sum(low.count(x) for x in terms)
        assert [r[c] for c in X.KEYWORD_COLUMNS] == [int(k in low) for k in KEYWORDS]
    r = rows[20]
    assert r["has_leetspeak"] == 1 and r["suspicious_tld"] == 1 and r["n_allcaps_words"] == 1 and r["brand_domain_mismatch"] == 0


def test_iso_date_and_json(spark):
    d = frame(spark, ["03/05/2021, 10:00:00", "13/45/2021", "x 03/05/2021", None])
    assert [str(r[0]) for r in d.orderBy("i").select(T.iso_date(F.col("text"))).collect()] == ["2021-03-05", "None", "None", "None"]
    j = frame(spark, ['ok {"a": {"b": 1}} bye', "{bad", "none", None])
    assert [r[0] for r in j.orderBy("i").select(T.json_object(F.col("text"))).collect()] == ['{"a": {"b": 1}}', None, None, None]


def test_snap_order_and_fallback(spark):
    d = frame(spark, ["BANK ALERT", "a bank alert!", "", "zzz", None])
    got = [r[0] for r in d.orderBy("i").select(T.snap(F.col("text"), ["bank alert", "other"], "other")).collect()]
    assert got == ["bank alert", "bank alert", "other", "other", "other"]


def test_wordpiece_exact_ids(spark):
    vocab = {w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "hello", ",", "你", "cafe"])}
    d = frame(spark, ["Unaffable, HELLO", "你hello", "Café xyz", None, "a" * 101])
    got = [r[0] for r in d.orderBy("i").select(wordpiece(F.col("text"), vocab)).collect()]
    assert got == [[1, 3, 4, 5, 7, 6, 2], [1, 8, 6, 2], [1, 9, 0, 2], None, [1, 0, 2]]
    assert spark.createDataFrame([([[3.0, 4.0], [3.0, 4.0]],)], "t array<array<double>>").select(pooled(F.col("t"))).first()[0] == [0.6, 0.8]


def test_lower_keeps_unicode(spark):
    values = [v for v in EDGE if v]
    got = [r[0] for r in frame(spark, values).orderBy("i").select(T.exact_key(F.col("text"))).collect()]
    assert got == [re.sub(r"\s+", " ", v.lower()).strip() for v in values]
    assert unicodedata.normalize("NFC", got[0]).startswith("café")


def test_prompts_and_token_counts_take_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "ab " * 300)], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(1, "ab " * 300), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert core.QUERIES["f15_template_fill"](spark, str(tmp_path)).collect()[0].prompt == f"Type of: {'ab ' * 300}\nA) yes\nB) no"
    counted = {r.doc_id: r.n for r in core.QUERIES["f18_wordpiece"](spark, str(tmp_path)).collect()}
    assert counted[1] == 602
    vocab = {w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", "a", "##b"])}
    ids = spark.createDataFrame([("ab " * 300,)], "t string").select(wordpiece(F.col("t"), vocab).alias("d"), wordpiece(F.col("t"), vocab, limit=10).alias("x")).collect()[0]
    assert len(ids.d) == 256 and ids.x == [1, *[3, 4] * 4, 2]
