import random
from urllib.parse import quote

import pytest
from editwake.operators import pairs as P
from editwake.operators import triage as T
from pyspark.sql import functions as F

EDITS = "wiki string, title string, qid string, bot boolean, seq bigint"


def universe(spark, *rows):
    return P.pages(spark.createDataFrame([(w, t, q, b, i) for i, (w, t, q, b) in enumerate(rows)], EDITS))


def paris(spark):
    return universe(spark, ("enwiki", "Paris", "Q90", False), ("frwiki", "Paris", "Q90", False), ("jawiki", "パリ", "Q90", False), ("enwiki", "Gift", "Q1", False), ("dewiki", "Gift", "Q2", False), ("itwiki", "Paris", "Q90", True))


def test_pairs_and_strata(spark):
    p = paris(spark)
    assert P.stratified(p).groupBy("stratum").count().orderBy("stratum").collect() == [("both", 1), ("naive_only", 1), ("wikidata_only", 2)]
    assert p.count() == 5


def test_sizes_without_pairs_equal_pairs(spark):
    rng = random.Random(1)
    p = universe(spark, *[(rng.choice("abcd"), rng.choice([None, "t1", "t2", "t3", "t4"]), rng.choice([None, "Q1", "Q2"]), False) for _ in range(60)])
    counted = {r.stratum: r["count"] for r in P.stratified(p).groupBy("stratum").count().collect()}
    assert {r.stratum: r.pairs for r in P.strata_sizes(p).collect()} == {s: counted.get(s, 0) for s in P.STRATA}


@pytest.mark.parametrize(("sizes", "want"), [((500, 500, 500), (66, 67, 67)), ((500, 10, 500), (95, 10, 95)), ((3, 2, 0), (3, 2, 0)), ((0, 0, 0), (0, 0, 0))])
def test_allocation(sizes, want):
    assert tuple(P.allocate(dict(zip(P.STRATA, sizes, strict=True)), 200).values()) == want


def test_sample_is_the_one_drawn_from_sorted_strata(spark):
    rng = random.Random(8)
    p = universe(spark, *[(rng.choice("abcde"), f"t{rng.randrange(40)}", f"Q{rng.randrange(30)}", False) for _ in range(150)])
    strata = {s: sorted(tuple(r)[:4] for r in P.stratified(p).where(F.col("stratum") == s).collect()) for s in P.STRATA}
    shares = P.allocate({s: len(x) for s, x in strata.items()}, 30)
    draw = random.Random(7)
    chosen = [(s, x) for s in P.STRATA for x in draw.sample(strata[s], shares[s])]
    draw.shuffle(chosen)
    got = P.labelling_sample(p, 30, 7).orderBy("pair_id").collect()
    assert [(r.stratum, (r.wiki_a, r.title_a, r.wiki_b, r.title_b)) for r in got] == chosen
    assert got[0].pair_id == "p001"


def test_urls_equal_the_usual_quoting(spark):
    titles = ["A b/c~d*e", "Ünï (x)", "パリ & co+", "100%?", "a'b!c", "-._"]
    df = spark.createDataFrame([("zh_yuewiki", t) for t in titles], "w string, t string")
    got = [r[0] for r in df.select(P.page_url(F.col("w"), F.col("t"))).collect()]
    assert got == [f"https://zh-yue.wikipedia.org/wiki/{quote(t.replace(' ', '_'))}" for t in titles]


def test_labels_reweighted(spark):
    words = [("both", "y"), ("both", "Same "), ("naive_only", "no"), ("naive_only", "0"), ("wikidata_only", "TRUE"), ("wikidata_only", "different"), ("both", "maybe")]
    labels = spark.createDataFrame([(f"p{i}", w) for i, (_, w) in enumerate(words)], "pair_id string, same_subject string")
    key = spark.createDataFrame([(f"p{i}", s) for i, (s, _) in enumerate(words)], "pair_id string, stratum string")
    sizes = spark.createDataFrame([("both", 100), ("naive_only", 50), ("wikidata_only", 40)], "stratum string, pairs bigint")
    r = P.evaluation(labels, key, sizes).first()
    assert (r.labelled, r.unlabelled, r.naive_precision, r.naive_recall, r.wikidata_precision, r.wikidata_recall, r.missed_by_naive) == (6, 1, 0.6667, 0.8333, 0.8571, 1.0, 20.0)
    none = P.evaluation(labels.where("pair_id in ('p0')"), key, sizes).first()
    assert (none.naive_precision, none.estimated_both, none.missed_by_naive) == (None, 100.0, None)
    with pytest.raises(Exception, match="no key for p0"):
        P.evaluation(labels, key.where("pair_id <> 'p0'"), sizes).collect()


REC = "qid string, rank int, lag_seconds bigint, leader_wiki string, leader_title string, leader_timestamp bigint, follower_wiki string, follower_title string, follower_timestamp bigint, follower_user string"
EV = "wiki string, title string, ts bigint, user_name string, edit_comment string, bytes_changed bigint, bot boolean, stream_skew_seconds double"


def case(spark, leader=None, follower=None, title="T"):
    rec = spark.createDataFrame([("Q1", 2, 5, "en", title, 1, "de", "T", 6, "rec user")], REC)
    ev = spark.createDataFrame([(w, t, ts, *x) for (w, t, ts), x in ((("en", title, 1), leader), (("de", "T", 6), follower)) if x], EV)
    r = T.suggested(T.with_evidence(rec, ev)).first()
    return r.suggested_category, r.evidence


PLAIN, OTHER = ("Ann", "fix", 500, False, 1.0), ("Bob", "add", 400, False, 1.0)


def test_cascade(spark):
    assert case(spark, PLAIN, OTHER) == ("needs_review", "")
    assert case(spark) == ("needs_review", "")
    assert case(spark, ("CleanBot", "", 1, False, 1.0), OTHER) == ("bot_slipped_filter", "leader user 'CleanBot'")
    assert case(spark, ("CleanBot", "fix", 100, True, 1.0), OTHER)[0] == "needs_review"
    assert case(spark, PLAIN, ("Bob", "ОТМЕНА правки", 1, False, 1.0)) == ("revert_or_vandalism", "follower comment 'ОТМЕНА правки'")
    assert case(spark, ("A", "RÜCKGÄNGIG " + "x" * 99, 1, False, 1.0))[1] == "leader comment 'RÜCKGÄNGIG " + "x" * 69 + "'"
    assert case(spark, PLAIN, OTHER, title="Mercury (disambiguation)") == ("disambiguation", "leader title 'Mercury (disambiguation)'")
    assert case(spark, ("A", "", 3, False, 1.0), ("B", "", -10, False, 1.0)) == ("trivial_maintenance", "size changes +3 / -10 bytes")
    assert case(spark, PLAIN, ("B", "", 99, False, -900.4)) == ("out_of_order", "follower stream skew -900s")
    assert case(spark, PLAIN, ("Ann", "", 99, False, None)) == ("same_editor", "user 'Ann' made both edits")
    assert case(spark, (None, None, None, None, None), ("", "", None, False, None))[0] == "needs_review"
    assert case(spark, ("O'Bot", "", 99, None, None), None)[1] == 'leader user "O\'Bot"'


def test_sheet_and_summary(spark):
    rec = spark.createDataFrame([(f"Q{i}", 2, i, "en", "T", 1, "de", "T", i, "u") for i in range(9)], REC)
    sheet = T.review_sheet(T.review_sample(rec, 5, 1), spark.createDataFrame([], EV))
    assert sheet.count() == 5 and len(sheet.columns) == 19 and sheet.first().leader_user == ""
    rows = [("f001", "same_editor", "yes", ""), ("f002", "same_editor", "y", " disambiguation "), ("f003", "x", "no", ""), ("f004", "x", "", "")]
    done = spark.createDataFrame(rows, "case_id string, suggested_category string, confirmed_wrong string, category string")
    assert T.review_agreement(done).first() == (4, 3, 2, 0.5)
    assert sorted(tuple(r) for r in T.review_summary(done).collect()) == [("disambiguation", 1, ["f002"]), ("same_editor", 1, ["f001"])]


def test_evidence_takes_the_first_event(spark):
    text = '{{"meta": {{"dt": "2021-01-04T00:00:{:02d}Z"}}, "wiki": "en", "title": "T", "timestamp": 1609718400, "user": "u{}", "length": {}}}'
    data = [("a", i, text.format(i, i, n)) for i, n in ((2, '{"old": 5, "new": 9}'), (1, '{"new": 7}'))]
    lines = spark.createDataFrame(data, "file string, line_no bigint, text string")
    r = T.first_evidence(T.evidence_of_lines(lines), ["file", "line_no"]).first()
    assert (r.user_name, r.bytes_changed, r.stream_skew_seconds, r.edit_comment) == ("u1", 7, 1.0, "")
