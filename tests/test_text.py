import re

from pyspark.sql import functions as F

from millrace.functions import model_output as M
from millrace.functions import text as T


def one(spark, expr, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values)))
    return df.select(expr(*map(F.col, names)).alias("x")).first().x


def test_sentences(spark):
    text = "A" * 19 + ". " + "B" * 20 + ". short. " + "C" * 25 + "\n\n" + "D" * 30
    assert one(spark, T.split_sentences, text) == ["B" * 20 + ".", "C" * 25, "D" * 30]
    assert one(spark, T.split_sentences, None) is None and one(spark, T.split_sentences, "") == []


def test_tokens_terms_and_expansion(spark):
    q = "What is the Größe of wört_1 in Wörter?"
    want = re.findall(r"\w+", q.lower())
    assert one(spark, T.tokenise, q) == want
    assert one(spark, T.key_terms, q) == ["größe", "wört_1", "wörter"]
    assert one(spark, T.expand_query, q) == [*want, "größe", "wörter"]


def test_fences_and_objects(spark):
    for raw, want in [("```json\n{\"a\": 1}\n```", '{"a": 1}'), ("```{\"a\": 1}", '{"a": 1}'), (' {"a": 1} ', '{"a": 1}')]:
        assert one(spark, T.strip_fence, raw) == want
    get = lambda c: M.parse_object(c, "a int")["a"]
    assert [one(spark, get, v) for v in ('```\n{"a": 3}\n```', "no json", "[1]", None)] == [3, None, None, None]


def test_a_bad_item_costs_only_itself(spark):
    raw = '```json\n[{"question": "one?"}, 7, "x", {"question": 3.5}, {"question": "two?"}]\n```'
    got = one(spark, lambda c: F.transform(M.parse_items(c, M.QUESTION), lambda i: i["question"]), raw)
    assert got[0] == "one?" and got[-1] == "two?" and len(got) in (2, 3)
    for bad in ("{}", "nothing", "", None):
        assert one(spark, lambda c: F.size(M.parse_items(c, M.QUESTION)), bad) == 0


def test_filters(spark):
    assert one(spark, T.leans_on_source, "What is mentioned in it?") and not one(spark, T.leans_on_source, "According to whom?")
    assert one(spark, lambda c: T.leans_on_source(c, True), "According to whom?")
    assert one(spark, T.is_vague, "What else?") and not one(spark, T.is_vague, "What else is there?")
    assert [one(spark, lambda c: T.long_enough(c, 10), v) for v in (" 123456789 ", "1234567890", None)] == [False, True, False]


def test_overlap(spark):
    j = lambda a, b: T.jaccard(a, b)
    assert one(spark, j, ["a", "b"], ["b", "c"]) == 1 / 3 and one(spark, j, [], []) == 0 and one(spark, j, ["a"], []) == 0
    assert one(spark, T.word_jaccard, "The cat ", "the  dog") == 1 / 3 and one(spark, T.word_jaccard, None, "x") == 0
    assert one(spark, T.normalise_terms, [" A ", "", "b"]) == ["a", "b"]


def test_scores_and_ratios(spark):
    parse = lambda c: M.checked_scores(M.parse_object(c, M.SCORES), ["faithfulness", "tone"]).isNotNull()
    assert one(spark, parse, '{"faithfulness": 0.5, "tone": 1}')
    assert not one(spark, parse, '{"faithfulness": 1.2, "tone": 1}') and not one(spark, parse, '{"tone": 1}')
    v = lambda c, w: M.verdict_ratio(c, w, "supported")
    assert one(spark, v, [], []) == 1.0 and one(spark, v, ["a"], []) == 0.0 and one(spark, v, ["a", "b", "c"], ["supported", "no", "Supported"]) == 0.667
    r = lambda a, b: M.ratio(a.cast("int"), b.cast("int"))
    assert one(spark, r, "1", "3") == 0.333 and one(spark, r, "1", "0") == 0 and one(spark, r, None, None) == 0


def test_display(spark):
    assert one(spark, lambda c: T.truncate(c, 3, "…"), "abcd") == "abc…" and one(spark, lambda c: T.truncate(c, 3, "…"), "abc") == "abc"
    assert one(spark, T.title_label, "follow_up_quality") == "Follow Up Quality"
    assert [one(spark, lambda c: T.score_band(c.cast("double")), s) for s in ("0.8", "0.6", "0.59")] == ["good", "warn", "bad"]
    assert one(spark, lambda c: T.human_bytes(c.cast("long")), "2048") == "2.0 KB"
    assert one(spark, lambda c: T.prompt("a {x} b", x=c), None) == "a  b"
