import math
import random
from collections import Counter

import numpy as np
import pytest
from editwake.llm import leftovers as L
from editwake.llm import mixing, packing, quantiles, tokens, topk, wording
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def exact(values, p):
    s = sorted(values)
    return s[max(1, math.ceil(round(p * len(s) / 100, 9))) - 1]


def measured(n=4_000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        g = rng.choices(["big", "mid", None, f"g{rng.randrange(40)}"], [40, 15, 5, 40])[0]
        rows.append((g, rng.choice([None, 0, -5, rng.randrange(30), int(rng.paretovariate(0.6) * 10)]), f"d{i % 5}", i))
    return rows


@pytest.mark.parametrize("block", [8, 512])
def test_percentiles_are_exact_however_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(quantiles, "BLOCK_VALUES", block)
    rows = measured()
    df = spark.createDataFrame(rows, "rank string, v bigint, day string, n bigint")
    out = quantiles.percentiles(df, ["rank"], "v", [0, 5, 50, 95, 99.5, 100]).collect()
    by = {}
    for g, v, *_ in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert len(out) == 6 * len(by)
    for r in out:
        assert (r.value, r.n) == (exact(by[r.rank], r.percent), len(by[r.rank]))
    assert min(r.rounds for r in out) > 1 and max(r.rounds for r in out) > 5  # the first round only proposes


def test_days_combine_and_doubles_with_ties(spark):
    rng = random.Random(9)
    rows = [("a", rng.choice([1.5, float(rng.random()), float("nan")]), f"d{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, day string")
    parts = quantiles.summary(df, ["g"], "v", part="day")
    days = parts.where("_ew_part = 'd0'").unionByName(parts.where("_ew_part <> 'd0'"))
    got = {r.percent: r.value for r in quantiles.select_percentiles(days, ["g"], [10, 50, 90]).collect()}
    real = [v for _, v, _ in rows if v == v]
    assert got == {float(p): exact(real, p) for p in (10, 50, 90)}


def test_error_is_bounded_and_summaries_stay_small(spark):
    rng = random.Random(4)
    rows = [("a", rng.choice([0, -1, 1]) * int(rng.paretovariate(0.3))) for _ in range(5_000)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    small = quantiles.summary(df, ["g"], "v", relative_error=0.01)
    assert small.count() < quantiles.summary(df, ["g"], "v").count()
    for r in quantiles.select_percentiles(small, ["g"], [5, 50, 95, 99]).collect():
        true = exact([v for _, v in rows], r.percent)
        assert abs(r.value - true) <= 0.01 * abs(true) + 1e-9


def test_decimals_no_groups_and_other_types(spark):
    df = spark.createDataFrame([(i, "x") for i in (5, 1, 4, 2, 3, None)], "v int, s string").selectExpr("cast(v as decimal(10,2)) / 4 as v", "v as i", "s")
    df = df.selectExpr("cast(v as decimal(10,2)) as v", "i", "s")
    assert [float(r.value) for r in quantiles.percentiles(df, [], "v", [50]).collect()] == [0.75]
    assert [r.value for r in quantiles.percentiles(df, [], "i", [100]).collect()] == [5]
    with pytest.raises(TypeError):
        quantiles.select_percentiles(df.selectExpr("s as _ew_v", "1L as _ew_n", "'' as _ew_part"), [], [50])


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "g string, v bigint")
    assert quantiles.percentiles(df, ["g"], "v", [50]).count() == quantiles.percentiles(df.limit(0), ["g"], "v", [50]).count() == 0


def words(n=6_000):
    rng = random.Random(6)
    return [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.33 else f"w{int(rng.paretovariate(0.5))}", i) for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 40, 100_000])
def test_most_frequent_values_are_exact(spark, k):
    rows = words()
    got = {r.value: r.n for r in topk.frequent(spark.createDataFrame(rows, "value string, n int").repartition(6), "value", k).collect()}
    count = Counter(w for w, _ in rows if w is not None)
    least = sorted(count.values(), reverse=True)[:k][-1]
    assert got == {w: n for w, n in count.items() if n >= least}


def test_values_by_share_and_small_nodes(spark, monkeypatch):
    rows = words()
    df = spark.createDataFrame(rows, "value string, n int").repartition(3)
    count = Counter(w for w, _ in rows if w is not None)
    got = {r.value: r.n for r in topk.frequent_share(df, "value", 0.01).collect()}
    assert got == {w: n for w, n in count.items() if n >= 0.01 * len(rows)}
    assert topk.frequent(df.limit(0), "value", 3).count() == topk.frequent_share(df.limit(0), "value", 0.5).count() == 0
    nulls = spark.createDataFrame([(None,)] * 9 + [("a",)], "value string")
    assert topk.frequent_share(nulls, "value", 0.1).collect() == [("a", 1)] and topk.frequent_share(nulls, "value", 0.11).count() == 0
    with pytest.raises(ValueError):
        topk.frequent(df, "value", 0)


def check_bins(sizes, clusters, bins, capacity):
    used, seen = Counter(), set()
    for s, c, b in zip(sizes, clusters, bins, strict=True):
        used[b] += s
        assert c < 0 or (b, c) not in seen
        seen.add((b, c))
    assert not sizes or max(used.values()) <= capacity
    return len(used)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(-1, 4), st.integers(0, 2)), max_size=60))
def test_best_fit_keeps_its_constraints(items):
    sizes, clusters, sources = ([x[i] for x in items] for i in range(3))
    bins = packing.best_fit(sizes, clusters, sources, 20)
    n = check_bins(sizes, clusters, bins, 20)
    copies = Counter(c for c in clusters if c >= 0)
    assert n >= max([-(-sum(sizes) // 20), *copies.values(), 0])


def tightest(sizes, clusters, capacity):
    """The same rule by looking at every bin for every item."""
    copies = Counter(c for c in clusters if c >= 0)
    rooms, holds = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-(copies[clusters[i]]), -sizes[i], clusters[i])):
        fits = [b for b in range(len(rooms)) if rooms[b] >= sizes[i] and (clusters[i] < 0 or clusters[i] not in holds[b])]
        b = min(fits, key=lambda b: rooms[b], default=None)
        if b is None:
            b = len(rooms)
            rooms.append(capacity)
            holds.append(set())
        rooms[b] -= sizes[i]
        holds[b].add(clusters[i])
    return sorted(rooms)


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(1, 120)
        clusters = [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
        fixed = {c: rng.randrange(1, 60) for c in range(3)}
        sizes = [fixed.get(c) or rng.randrange(1, 100) for c in clusters]
        bins = packing.best_fit(sizes, clusters, [0] * n, 100)
        used = Counter()
        for s, b in zip(sizes, bins, strict=True):
            used[b] += s
        assert sorted(100 - u for u in used.values()) == tightest(sizes, clusters, 100)


def test_many_copies_take_time_in_proportion():
    import time

    start = time.time()
    packing.best_fit([5] * 6_000 + [90] * 10_000, [0] * 6_000 + [-1] * 10_000, [0] * 16_000, 100)
    assert time.time() - start < 20


def test_packing_places_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 40)
    rng = random.Random(1)
    rows = [(i, rng.choice([0, None, 3, 50, 99, 100, 101, 250, 1_234]), rng.choice([None, 1, 2, i]), rng.choice([None, "a", "b"]), "own") for i in range(300)] + [(7, 50, 5, "a", "own")]
    items = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, cluster bigint, source string, bin string")
    caps = spark.createDataFrame([("s", 100), ("l", 1_000), ("none", 0)], "pack_name string, capacity_tokens int")
    out = packing.pack(items, caps)
    for name, cap in (("s", 100), ("l", 1_000)):
        got = out.where(f"pack_name = '{name}'").collect()
        assert sum(r.tokens for r in got) == sum(r[1] or 0 for r in rows)
        per = Counter(r.doc_id for r in got)
        for i, size, *_ in rows[:-1]:
            assert i == 7 or per[i] == (-(-size // cap) if size else 0)
        used = Counter()
        for r in got:
            used[r.bin] += r.tokens
        assert max(used.values()) <= cap
    fill = {r.pack_name: r for r in packing.fill(out).collect()}
    assert all(r.clashes >= 0 and r.overfull == 0 for r in fill.values())
    assert out.where("cluster is not null").groupBy("pack_name", "bin", "cluster").agg({"doc_id": "approx_count_distinct"}).where("`approx_count_distinct(doc_id)` > 1").count() == 0
    assert packing.pack(items.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, caps.limit(0))


def test_packing_is_checked(spark):
    items = spark.createDataFrame([(1, 5, 7, "a"), (2, 5, 7, "a"), (3, 25, None, "b"), (3, 4, None, "b"), (4, 0, 1, "b"), (5, None, 1, None)], "doc_id bigint, tokens bigint, cluster bigint, source string")
    sizes = spark.createDataFrame([("s", 10)], "pack_name string, capacity_tokens int")
    packed = packing.pack(items, sizes)
    assert [tuple(r) for r in packing.checked(packed, items, sizes).collect()] == [("s", 10, 3, 0, 0, 0, 0)]
    bad = packed.where("doc_id <> 1").withColumn("bin", F.lit(1).cast("bigint"))
    assert [tuple(r) for r in packing.checked(bad, items, sizes).collect()] == [("s", 10, 2, 1, 0, 1, 0)]


def test_temperature_meets_an_entropy():
    sizes = {"a": 0.9, "b": 0.09, "c": 0.01, "none": 0.0}
    for target in (1.0, 0.6, 0.1):  # the natural shares have 0.36: more needs an exponent below 1, less one above
        e = mixing.exponent_for_entropy(sizes, target)
        assert abs(mixing.entropy(mixing.tempered(sizes, e)) - target) < 1e-6 and (e < 1) == (target > mixing.entropy(sizes))
    assert abs(mixing.exponent_for_entropy(sizes, math.log(3))) < 1e-6


def test_exponent_keeps_a_repetition_limit():
    shares = {"a": 0.9, "b": 0.09, "c": 0.01}
    e = mixing.exponent_for_limits(shares, {"a": 1.0, "b": 0.3, "c": 0.05})
    w = mixing.tempered(shares, e)
    assert 0 < e < 1 and (abs(w["b"] - 0.3) < 1e-6 or abs(w["c"] - 0.05) < 1e-6) and w["b"] <= 0.3 + 1e-6 and w["c"] <= 0.05 + 1e-6
    assert mixing.exponent_for_limits(shares, dict.fromkeys(shares, 1.0)) == 0 and mixing.exponent_for_limits(shares, dict.fromkeys(shares, 0.3)) is None


def test_plan_stays_within_repeats():
    sizes, targets, repeats = {"a": 1_000, "b": 100}, {"a": 0.5, "b": 0.5, "gone": 0.2}, {"a": 1, "b": 3, "gone": 2}
    p = mixing.plan(sizes, targets, repeats)
    assert p["a"]["budget"] == p["b"]["budget"] == 300 and p["gone"]["budget"] == 0
    tight = mixing.plan(sizes, targets, repeats, total=1_200, exact=False)
    assert 299 <= tight["b"]["budget"] <= 300 and 899 <= tight["a"]["budget"] <= 900 and 0 < tight["a"]["exponent"] < 1
    assert mixing.plan(sizes, {}, repeats) == {} and mixing.plan({}, targets, repeats)["a"]["budget"] == 0


def test_mix_reaches_shares_without_too_many_uses(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    monkeypatch.setattr(mixing, "SUPER", 4)
    rng = random.Random(5)
    rows = [(i, rng.choices(["big", "small", "mid", None, "unlisted"], [60, 5, 25, 5, 5])[0], rng.choice([None, 0, 5, 20, 40]), "x") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, use string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.3, 2), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    used = mixing.used_rows(docs, targets)
    budget = mixing.budgets(used, targets)
    mixed = mixing.mix(used, budget).cache()
    got = {r.source: r for r in mixing.shares(mixed, targets, budget).collect()}
    assert got["absent"].reached_tokens == 0 and all(r.met and r.within_repeats for r in got.values())
    for s, t in (("big", 0.5), ("small", 0.2), ("mid", 0.3)):
        assert abs(got[s].reached_share - t) < 0.01
        assert got[s].most_uses <= got[s].max_repeats
    placed = mixed.collect()
    uses = Counter((r.source, r.doc_id, r.use) for r in placed)
    assert max(uses.values()) == 1
    size = {r[0]: r[2] for r in rows}
    assert all(r.tokens == size[r.doc_id] for r in placed)
    assert sorted(map(tuple, placed)) == sorted(map(tuple, mixing.mixed(docs.repartition(7), targets).collect()))
    for s in ("big", "small", "mid"):  # positions are the running sums of a permutation, pass after pass
        mine = sorted((r for r in placed if r.source == s), key=lambda r: r.position)
        upto = 0
        for r in mine:
            assert abs(r.position - upto / budget[s]["budget"]) < 1e-9
            upto += r.tokens
        assert [r.use for r in mine] == sorted(r.use for r in mine)
    half = Counter()
    for r in placed:
        half[r.source] += r.tokens if r.position < 0.5 else 0
    assert all(abs(half[s] / sum(half.values()) - got[s].reached_share) < 0.03 for s in half)
    first, second = ([r.doc_id for r in sorted((x for x in placed if x.source == "small" and x.use == u), key=lambda r: r.position)] for u in (1, 2))
    assert sorted(first) == sorted(second) and first != second
    assert mixing.mixed(docs.limit(0), targets).count() == 0


def test_tokens_of_whole_texts(spark):
    texts = ["hello world", "", None, "日本語 " * 3_000, "a" * 200_000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df).collect()}
    coder = tokens.encoding(tokens.VOCABULARY)
    assert got == {i: None if t is None else len(coder.encode_ordinary(t)) for i, t in enumerate(texts)} and got[0] == 2


@pytest.mark.parametrize("text", [
    "Welcome, {{name}}!", "Born in {{{year|}}}.", "Dear ${user_name},", "Thanks for %(place)s.", "The <<city>> team", "Hello <%= name %>.", "On *|DATE|* we met.", "At @@PLACE@@ now.", "A [TODO: date] B",
    "See [insert name].", "By (author here) today.", "Title: [object Object]", "In NaN, more", "From {0} to {1}.", "Hello [Name], thanks", "&first_name; was here", "Hi %FIRSTNAME%!", "Gruß an __name__.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Real start.\nYour text here.", "Tekst tekst tekst tekst.", "xxx xxxx xx xxxxx", "ここに本文が入ります。", "Test test 4 test, please ignore",
    "404 Not Found", "Error 503: Service unavailable.", "> Erreur 410 : accès refusé.", "<noscript>Something went wrong.</noscript>", '{"error": {"code": 5}}', "java.lang.NullPointerException", "Seite nicht gefunden",
    "This page requires JavaScript to be enabled.", "Diese Seite benötigt JavaScript.", "Карта не работает без скриптов.", "此页面需要启用JavaScript。", "The map needs JavaScript. It shows rivers.", "asdf jkl; asdf qwer jkl fdsa",
])
def test_leftovers_are_found(text):
    assert L.leftovers(text)[0]
    assert L.leftovers("The river rises in the hills. " * 30 + "\n" + text)[0]


@pytest.mark.parametrize("text", [
    "", "Please keep {{cite book|title=X|year=1928}} as it is.", "{{convert|11|km}} [[A|B]] [sic] [12] [note 3] <br> <ref>p. 4</ref> __NOTOC__ ''x''", "It cost $23 million (19 %) & more; see §5.",
    "The error 404 in the lookup column means that the page was deleted.", "The variable ${title} is explained in the guide.", "%s in a message stands for the page name and [NAME] for the editor.",
    "The phrase lorem ipsum has been used by printers since 1914.", 'He quoted the old message "service temporarily unavailable" and asked why.', "Readers without JavaScript see the plain table.",
    "In 1952 the web team dropped the notice that asked visitors to enable JavaScript.", "Der Hinweis, JavaScript zu aktivieren, wurde gestrichen.", "Parameters are written with three braces, as in {{{1}}}.",
    "rv, see talk", "What happened?? Nothing... really", "a < b and c > d", "Back in 2010 we were all free.", "Forbidden City", "The team was not found wanting.",
])
def test_what_only_looks_like_it_is_left(text):
    assert L.leftovers(text)[0] == []


def test_documents_judged(spark):
    low, real = "Désolé. Back.", "A river in the north."
    data = [(1, real, "en"), (2, None, "en"), (3, "", "en"), (4, low, "en"), (5, low, "en"), (6, low, "de"), (7, "Hi {{x}}. " + "word " * 200_000, "en"), (7, real, None), (8, "rv, see talk", "en"), (9, "rv, see talk", "en")]
    docs = spark.createDataFrame([(*x, ["k"]) for x in data], "doc_id bigint, text string, wiki string, kinds array<string>")
    out = L.judged(docs)
    assert out.count() == len(data)
    assert sorted(r.doc_id for r in out.where("leftover").collect()) == [4, 5, 7]
    kept = L.without_leftovers(docs.where("doc_id <> 7"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 8, 9] and kept.columns == docs.columns
    assert L.judged(docs.limit(0)).count() == 0


def test_suspected_wording_needs_other_pages_and_no_common_term(spark):
    """Wording that is only suspected: settled by how many pages serve it, and by their titles and slugs."""

    class Suspects:
        def score(self, passages):
            return np.array([0.0 if "blue" in p or "elsewhere" in p else -9.0 for p in passages])

    text, other = "The blue form is gone.", "Look elsewhere."
    data = [(1, text, "h", "Q1", "Red deer"), (2, text, "h", "Q2", "Elk"), (3, text, "h", "Q3", "Blue whale"), (4, other, "h", "Q4", "Elk"), (5, other, "h", "Q4", None), (6, "Fine.", None, None, None), (7, text, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, wiki string, qid string, name string")
    found = lambda **how: sorted(r.doc_id for r in L.judged(docs, model=Suspects(), page="qid", **how).where("leftover").collect())
    assert found() == [1, 2, 3, 7]  # the other wording stands on one page only
    assert found(title="name") == [1, 2, 7] == found(address="name")
    titles = docs.selectExpr("wiki as host", "qid as page", "name as title")
    assert found(titles=titles) == [1, 2, 7]
    assert found(copies=4) == [1, 2, 3, 7] and found(copies=5) == []


def test_wording_not_among_the_examples_is_told_from_real_text():
    """Recall on held-out wording, a fifth of the examples at a time; real sentences stay apart."""
    real = dict.fromkeys(L._phrases(L.ORDINARY), 5) | {f"the village of {a}{b} lies on the {c} river": 3 for a in ("za", "ko", "mi") for b in ("nor", "bel") for c in ("upper", "lower")}
    hit = 0
    for k in range(5):
        model = wording.fit([x for i, x in enumerate(L.EXAMPLES) if i % 5 != k], real)
        hit += int((model.score([x for i, x in enumerate(L.EXAMPLES) if i % 5 == k]) > L.SUSPECT).sum())
        assert (model.score(list(real)) < L.SUSPECT).mean() > 0.9
    assert hit >= 0.9 * len(L.EXAMPLES)


def test_wording_of_any_text():
    model = L.default_model()
    assert len(model.score([])) == 0 and np.isfinite(model.score(["", "x", "ж" * 100_000, "\ud800"])).all()
    assert np.allclose(model.score(["page not found", "a river"]), np.r_[model.score(["page not found"]), model.score(["a river"])])
