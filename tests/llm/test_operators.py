"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.llm import kdtree, kn_lm, quality_crf, source_mix, toxicity
from arcweave.llm import ngram_join as ngram_join_module
from arcweave.llm._shared import words
from arcweave.llm.components import components
from arcweave.llm.exact_dedup import exact_dedup
from arcweave.llm.line_dedup import line_dedup, repeated_runs
from arcweave.llm.ngram_join import ngram_join, prefix, shingles
from arcweave.llm.url_filter import best_rule, split_url, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, id long, t string, h string"
LONG = "word " * 40_000


def odd_rows():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(4)]
    texts = [None, "", " \n\t ", "one", "one two", "A b C", "a b c", LONG, LONG, "é ñ\n漢字 x", "x\ny\nz"]
    texts += [b for b in base for _ in range(3)] + [b + " end" for b in base] + ["dup dup dup dup"] * 5
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else f"src{i % 2}", None, True, 0.5, -1, "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "a b c", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, nothing, keep):
    rows = odd_rows()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    best = {t: (min if keep == "smallest" else max)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((r[0], best[r[1] or ""], len(groups[r[1] or ""]), r[0] == best[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=repr)
    assert sorted(map(tuple, exact_dedup(docs, keep=keep).collect()), key=repr) == want
    assert exact_dedup(nothing).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(docs, keep="any")


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- urls


def test_split_url_and_rules(spark):
    urls = [(None,), ("",), ("example.com/en/1",), ("http://A.Example.COM/en/7?x#y",), ("x://h",), ("x://h?q=/a",), ("a://b://c/d",), ("https://notexample.com/en/7",), ("https://q.net/de/8#z",), ("https://example.net/de/8",)]
    host, path = split_url(F.coalesce("u", F.lit("")))
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8")]
    df = spark.createDataFrame(urls, "u string").select("u", host.alias("h"), path.alias("p")).withColumn("r", best_rule(F.col("h"), F.col("p"), rules))
    got = {r.u: (r.h, r.p, r.r and r.r.rule) for r in df.collect()}
    assert got[None] == got[""] == got["example.com/en/1"] == ("", "", None)
    assert got["http://A.Example.COM/en/7?x#y"] == ("a.example.com", "/en/7", "example.com/en/7")
    assert got["x://h"] == got["x://h?q=/a"] == ("h", "", None) and got["a://b://c/d"][:2] == ("b:", "//c/d")
    assert got["https://notexample.com/en/7"][2] == "com/en/" and got["https://example.net/de/8"][2] == "example.net/de/8" and got["https://q.net/de/8#z"][2] == "net/de/"


def test_distrust_reaches_who_links_to_blocked(spark):
    link = '<a class="x" href="{}">x</a>'
    pages = [(1, "http://good.org/", None), (2, "http://bad.com/x", ""), (3, "http://friend.io/", link.format("http://BAD.com/y")), (4, "http://fan.io/", link.format("//good.org/z") + link.format("/self")), (5, "http://liked.io/", ""), (6, "http://good.org/2", link.format("https://liked.io")), (7, None, None), (8, "http://lone.io/", link.format("mailto:a@b")), (8, "http://lone.io/", None), (None, "http://friend.io/q", None)]
    df = spark.createDataFrame([(*p, "clash", 1, 2) for p in pages], "page_id long, url string, html string, host string, trust long, m long")
    out = url_filter(df, [("allow", "good.org", "/"), ("block", "bad.com", "/")]).collect()
    verdict = collections.defaultdict(set)
    for r in out:
        verdict[r.host].add((r.verdict, r.rule))
    assert verdict == {"good.org": {("allow", "good.org/")}, "bad.com": {("block", "bad.com/")}, "friend.io": {("block", None)}, "fan.io": {("allow", None)}, "liked.io": {("allow", None)}, "lone.io": {("allow", None)}, "": {("allow", None)}}
    assert len(out) == len(pages)
    assert url_filter(df.limit(0), [("allow", "a", "/")]).count() == 0


def test_small_shares_of_distrust_arrive(spark):
    """20,000 blocked hosts; 200 hosts link to one of them, and 200 others to all of those."""
    to = lambda host, n: f"""concat_ws('', transform(sequence(0, {n}), x -> concat('<a href="http://{host}', x, '.io/">')))"""
    pages = spark.range(20_000).selectExpr("concat('http://h', id, '.bad/') url", "'' html")
    near = spark.range(200).selectExpr("concat('http://n', id, '.io/') url", """'<a href="http://h0.bad/">' html""")
    far = spark.range(200).selectExpr("concat('http://f', id, '.io/') url", f"{to('n', 199)} html")
    out = url_filter(pages.union(near).union(far).selectExpr("1L page_id", "url", "html"), [("block", "bad", "/")])
    assert {(r.verdict, r["count"]) for r in out.groupBy("verdict").count().collect()} == {("block", 20_400)}


def test_distrust_goes_all_the_way(spark):
    """A chain of hosts that leads to a blocked one, and a circle beside it."""
    pages = spark.range(1, 24).selectExpr("id page_id", "concat('http://h', id, '.io/') url", """concat('<a href="http://h', id - 1, if(id = 1, '.bad', '.io'), '/">') html""")
    pages = pages.union(spark.sql("""values (0L, 'http://h0.bad/', ''), (90L, 'http://x.io/', '<a href="//y.io"><a href="//ok.org">'), (91L, 'http://y.io/', '<a href="//x.io">'), (92L, 'http://ok.org/', '<a href="//x.io">')"""))
    out = {r.page_id: r for r in url_filter(pages, [("block", "bad", "/"), ("allow", "ok.org", "/")]).collect()}
    assert {i for i, r in out.items() if r.verdict == "block"} == set(range(24))
    # ok = 0.15 + 0.85 x / 2, y = 0.85 x / 2, x = 0.85 (ok + y), in 10^9
    x = 0.85 * 0.15 / (1 - 0.85**2)
    assert all(abs(out[i].trust - 10**9 * want) < 10**4 for i, want in ((90, x), (91, 0.425 * x), (92, 0.15 + 0.425 * x)))


def test_links_of_any_quoting(spark):
    html = ["<a href=http://bad.com/x>", "<A title='a > b' HREF='//bad.com?q'>", '<a href="http://bad.com/?a>b">', '<a rel=x href = "http://bad.com/it\'s">', "<a\nclass=\"x\"href='http://bad.com'>", "<a data-href='http://bad.com'>", "<abbr href='http://bad.com'>", "<a title='href=//bad.com'>"]
    df = spark.createDataFrame([(i, f"http://h{i}.io/", x) for i, x in enumerate(html)] + [(99, "http://bad.com/", "")], "page_id long, url string, html string")
    out = {r.page_id: r.verdict for r in url_filter(df, [("block", "bad.com", "/")]).collect()}
    assert [out[i] for i in range(8)] == ["block"] * 5 + ["allow"] * 3


# --- mixing


def test_pfair_is_within_a_block():
    for shares in ({"a": 5, "b": 3, "c": 2}, {"a": 1}, {"a": 97, "b": 1, "c": 2}, {"x": 7, "y": 7, "z": 1, "w": 30}):
        q, order = sum(shares.values()), source_mix.pfair_period(shares)
        assert collections.Counter(order) == shares
        done = collections.Counter()
        for t, s in enumerate(order, 1):
            done[s] += 1
            assert all(abs(done[x] - t * p / q) < 1 for x, p in shares.items())


def test_phases_hold_every_block_once():
    blocks, shares = {"a": 10, "b": 1, "c": 57, "d": 3}, {"a": 2, "b": 5, "c": 1, "d": 9}
    taken, slots = collections.Counter(), set()
    for s, lo, hi, at, q, p, own in source_mix.phases(blocks, shares):
        for b in range(lo, hi + 1):
            slot = at + (b - lo) // p * q + own[(b - lo) % p]
            assert slot not in slots
            slots.add(slot)
            taken[s] += 1
    assert taken == blocks and slots == set(range(71))


def test_mix_keeps_all_rows(spark, docs, nothing):
    out = source_mix.mix_sources(docs, {"src0": 3, "gone": 2}, block=2)
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and len({r["__pos"] for r in rows}) == len(rows)
    assert {r["__stream"] for r in rows} == {"src0", ""}
    for s in ("src0", ""):
        mine = sorted((r["__block"], r["__slot"]) for r in rows if r["__stream"] == s)
        assert mine == sorted(mine, key=lambda x: x[1]) and [b for b, _ in mine][::2] == list(range((len(mine) + 1) // 2))
    assert source_mix.mix_sources(nothing, {"a": 1}).count() == 0
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    got = [r.source for r in source_mix.mixed(big, {"a": 5, "b": 3, "c": 2}, block=10).collect()]
    first = collections.Counter(got[:1900])
    assert len(got) == 3000 and abs(first["a"] - 950) <= 10 and abs(first["b"] - 570) <= 10
    with pytest.raises(ValueError):
        source_mix.mix_sources(docs, {"a": 0})


# --- line dedup


def brute_lines(rows, least):
    texts = sorted(((r[0] if r[0] is not None else -1, r[1]) for r in rows if r[1] is not None), key=lambda x: x[0])
    lines = {(i, t): t.encode().split(b"\n") for i, t in texts}
    cut = collections.defaultdict(set)
    seen = {}
    for key in sorted(lines, key=lambda k: (k[0], k[1])):
        seen[key] = lines[key]
    places = [(k, i) for k in lines for i in range(len(lines[k]))]
    for k, i in places:
        own, best = lines[k], 0
        for k2, j in places:
            if (k2[0], k2 == k and j) < (k[0], i) and (k2[0] < k[0] or k2 == k and j < i):
                n = 0
                while i + n < len(own) and j + n < len(lines[k2]) and own[i + n] == lines[k2][j + n]:
                    n += 1
                if sum(len(x.split()) for x in own[i : i + n]) >= least:
                    best = max(best, n)
        cut[k] |= set(range(i, i + best))
    return {k: b"\n".join(x for i, x in enumerate(v) if i not in cut[k]).decode() for k, v in lines.items()}


def test_line_dedup_against_brute_force(spark, nothing):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 3, 4, 12]))) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        if i % 4 == 0 and rows and rows[-1][1]:
            lines += rows[-1][1].split("\n")
        rows.append((i, "\n".join(lines)))
    rows += [(100, "a b c d e f g h i j\n" * 6), (101, None), (102, ""), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "doc_id long, text string, u long, line string, __cuts int")
    out = line_dedup(df, min_words=10)
    assert out.columns[:5] == df.columns
    want = brute_lines(sorted(set(r for r in rows if r[1] is not None)), 10)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(rows)
    for i, t in rows:
        assert (i, None if t is None else want[i, t]) in got
    assert line_dedup(nothing).count() == 0


def test_runs_of_blocks(spark):
    rng = random.Random(4)
    rows = {(d, 7, rng.randrange(60), rng.randint(1, 5)) for d in range(6) for _ in range(12)}
    got = repeated_runs(spark.createDataFrame(sorted(rows), "id long, u long, first int, size int")).collect()
    want = {(d, i) for d, _, first, size in rows for i in range(first, first + size)}
    assert sorted((r.id, i) for r in got for i in range(r.first, r.end)) == sorted(want)
    ends = {(r.id, r.end) for r in got}
    assert all((r.id, r.first) not in ends for r in got)


def test_line_dedup_takes_time_in_proportion_to_lines(spark):
    """A text of many copied and many own lines: twice the lines, no more than three times the time."""
    took = []
    for n in (10_000, 10_000, 20_000):  # the first one warms up
        shared = [f"shared line {i} of the two texts " + "w " * 60 for i in range(n)]
        own = [f"own line {i}" for i in range(n)]
        mixed = [x for pair in zip(shared, own, strict=True) for x in pair]
        df = spark.createDataFrame([(1, "\n".join(shared)), (2, "\n".join(mixed))], "doc_id long, text string")
        began = time.perf_counter()
        got = {r.doc_id: (r["__n_lines"], r["__n_removed"], r.text) for r in line_dedup(df).collect()}
        took.append(time.perf_counter() - began)
        assert got[1][:2] == (n, 0) and got[2][:2] == (2 * n, n) and got[2][2] == "\n".join(own)
    assert took[2] < 3 * max(took[1], 5)


def test_line_dedup_odd_rows(docs):
    out = line_dedup(docs, min_words=50)
    assert out.count() == len(odd_rows()) and out.filter("text is null").count() == 1
    long = sorted(r.text for r in out.filter("doc_id in (7, 8)").collect())
    assert long == ["", LONG]


# --- n-gram join


def brute_join(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 30)])
def test_ngram_join_against_brute_force(spark, docs, n, num):
    rng = random.Random(n)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.choice([2, 30, 120]))] for _ in range(8)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 9])):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "solo")]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, n long, sig binary")
    assert {r[0]: (r[1], r[2]) for r in ngram_join(df, n, num, 100).collect()} == brute_join(rows, n, num, 100)


def near_copies(rng, many, families=1, words_=200, edits=1):
    rows = []
    for f in range(families):
        base = [f"f{f}w{i}" if i % 2 else f"w{i}" for i in range(words_)]
        for i in range(many // families):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"v{f}x{i}y{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_ngram_join_in_many_blocks(spark, monkeypatch):
    """Lists far longer than a block, of several families and of rows that only chains link, against brute force."""
    monkeypatch.setattr(ngram_join_module, "BLOCK", 4)
    rng = random.Random(11)
    rows = near_copies(rng, 90, families=3, words_=60, edits=2)
    chain = [f"c{i}" for i in range(60)]
    for i in range(40):  # each differs from the one before in one word more
        chain[i] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_join(rows, 3, 90, 100)
    assert {r[0]: (r[1], r[2]) for r in ngram_join(df, 3, 90, 100).collect()} == want
    assert 3 < len({c for _, c in want.values()}) < 100


@pytest.mark.parametrize("many", [2000, 6000])
def test_ngram_join_verifies_few_pairs_of_copies(spark, monkeypatch, many):
    """Two a row at most, however many copies there are."""
    asked, check = [], ngram_join_module.verified

    def counted(pairs, *more):
        pairs = pairs.cache()
        asked.append(pairs.count())
        return check(pairs, *more)

    monkeypatch.setattr(ngram_join_module, "verified", counted)
    df = spark.createDataFrame(near_copies(random.Random(2), many), "doc_id long, text string")
    assert {r.component_id for r in ngram_join(df, 3, 90, 100).collect()} == {0}
    assert sum(asked) <= 2 * many


def test_ngram_join_odd_rows(docs, nothing):
    rows = odd_rows()
    got = ngram_join(docs, 3, 90, 100).collect()
    assert len(got) == len(rows)
    want = brute_join([(r[0], r[1]) for r in rows if r[0] is not None], 3, 90, 100)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert ngram_join(nothing).count() == 0
    with pytest.raises(ValueError):
        ngram_join(docs, id_col="text")


def test_prefixes_never_miss_a_partner():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 1 << 12).astype(np.uint32)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(3, 80)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 6)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 5 * both < 4 * (len(x) + len(y) - both):
            continue
        (p, a), (q, b) = prefix(x, counts, 80, 100), prefix(y, counts, 80, 100)
        assert len(np.intersect1d(p, q)) >= min(a, b)


def test_shingles_of_short_texts():
    assert len(shingles("a b", 3)) == 1 and len(shingles("A  B", 3)) == 1 and len(shingles(" ", 3)) == 0
    assert shingles("a b", 3)[0] == shingles("A\tb", 3)[0] != shingles("b a", 3)[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 299)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[300] == got[299] == 299


# --- search


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(0, 0.4, (700, 8))
    points[50:120] = points[50]
    points[200:210] = 0
    rows = [(int(i), [float(x) for x in p], "c", 3) for i, p in enumerate(points)]
    rows += [(9001, None, "c", 3), (9002, [1.0, None] + [0.0] * 6, "c", 3), (9003, [float("nan")] * 8, "c", 3), (9004, [float("inf")] * 8, "c", 3), (None, [0.1] * 8, "c", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, shard int")
    whole = np.floor(64 * points).astype(np.int64)
    want = set()
    for q in range(0, 700, 20):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        want |= {(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)}
    assert {tuple(r) for r in kdtree.top_k(df, lambda x: x % 20 == 0).collect()} == want
    few = kdtree.top_k(df.filter("vec_id < 5"), lambda x: x % 20 == 0, k=20)
    assert few.count() == 4
    assert kdtree.top_k(df.limit(0), lambda x: x % 20 == 0).count() == 0


def test_top_k_of_ragged_empty_and_large_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, []), (3, [0.5, 0.5, 0.5]), (4, [-40_000.0, 7.0]), (20, [2.0**22, -1.0]), (40, [2.0**21 + 0.5, 3.0]), (60, []), (80, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] + [0] * (3 - len(v)) for i, v in rows}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])]
    assert sorted(tuple(r) for r in kdtree.top_k(df, lambda x: x % 20 == 0, 4).collect()) == sorted(want)
    assert max(s for *_, s in want) > 2**53
    blank = spark.createDataFrame([(0, []), (1, []), (2, [])], df.schema)
    assert sorted(tuple(r) for r in kdtree.top_k(blank, lambda x: x == 0, 4).collect()) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    with pytest.raises(Exception, match="64 bits"):
        kdtree.top_k(spark.createDataFrame([(0, [1e17]), (1, [1e17])], df.schema), lambda x: x == 0, 4).collect()


def test_trees_leave_out_boxes():
    rng = np.random.default_rng(2)
    points = rng.integers(-60, 60, (4000, 2))
    tree = kdtree.build(points, np.arange(4000))
    s = kdtree.Search(np.arange(40), points[:40], 5)
    s.add(tree)
    assert s.visits < 0.3 * 40 * (len(tree.starts) - 1)
    again = kdtree.Search(np.arange(40), points[:40], 5)
    again.scores, again.found = s.scores.copy(), s.found.copy()
    again.add(tree)  # with the kth scores known, whole subtrees are left out
    assert again.opened < 0.5 * 40 * len(tree.left)
    for i in range(40):
        p = points @ points[i]
        order = [j for j in np.lexsort((np.arange(4000), -p)) if j != i][:5]
        assert list(s.found[i]) == order


# --- language model


def test_kneser_ney_sums_to_one_and_odd_rows(spark, docs, nothing, tmp_path):
    for order in (2, 3):
        out, model = kn_lm.score_corpus(docs, F.col("doc_id").isNotNull() & (F.col("doc_id") % 3 != 0), order)
        rows = out.collect()
        assert len(rows) == len(odd_rows()) and all(r.score < 0 and r.base_score < 0 and r.n_known <= r.n_tokens for r in rows)
        empty = next(r for r in rows if r.doc_id == 1)
        assert empty.n_tokens == 1 and empty.n_known == 1
        vocab = sorted({w for r in odd_rows() if r[0] is not None and r[0] % 3 for w in words(r[1])})
        assert model.types == len(vocab) + 1
        reader = kn_lm.Reader(model)
        for context in ([b"a"] * (order - 1), [b"never"] * (order - 1), [vocab[0]] * (order - 1)):
            last = np.concatenate([kn_lm.word_hashes([*vocab, b"~unknown~"]), [kn_lm.END]])
            flat = np.stack([*[np.full(len(last), h) for h in kn_lm.word_hashes(context)], last], axis=1).ravel()  # a text for each last word
            logs = reader.log10(flat, np.full(len(last), order))[0][order - 1 :: order]
            assert math.isclose((10**logs).sum(), 1, rel_tol=1e-9)
    out, model = kn_lm.score_corpus(nothing, F.lit(True))
    assert out.count() == 0 and model.tokens == 0


# --- classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    plain = ["the", "house", "river", "green", "slow", "light", "stone", "paper", "cloud", "garden"]
    docs, labels = [], []
    for i in range(400):
        bad, poor = i % 5 == 0, i % 4 == 1
        w = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 80))]
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "vile" + rng.choice(["st", "ly", "ness"]))
        lines = [" ".join(w[k : k + 12]) + "." for k in range(0, len(w), 12)]
        if poor:
            lines = lines[:1] + [" ".join(f"{x.upper()}!!" for x in line.split()) for line in lines[1:]] + ["| a | b | c |"] * 3
        docs.append((i, "\n".join(lines)))
        if i % 2 == 0 or poor:
            labels.append((i, int(not poor), int(bad)))
    docs += [(1000, None), (1001, ""), (1002, LONG), (None, "vilely vilest house"), docs[5], docs[5]]
    labels += [(None, 1, 1), (2000, None, None)]
    return spark.createDataFrame([(*d, 0.1) for d in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_what_it_never_saw(labelled, spark):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = [r for r in toxicity.score(docs, model).collect()]
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).score > 0.5 and next(r for r in got if r.doc_id == 1002).score < 0.3
    kept = toxicity.reject(docs, model, 0.5)
    assert kept.columns == docs.columns and 300 < kept.count() < docs.count()
    nobody = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert max(r.score for r in toxicity.score(docs, nobody).collect()) < 0.01
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_nnpu_uses_the_prior():
    rng = np.random.default_rng(0)
    n = 600
    positive = np.arange(n) < 100
    toxic = positive | ((np.arange(n) >= 100) & (rng.random(n) < 0.2))
    texts = [" ".join(["vilest" if t else "gentle"] * 5 + ["plain"] * 20) for t in toxic]
    model = toxicity.nnpu(*toxicity.sparse(texts), positive, 0.2)
    s = toxicity.score_texts(model, texts, {})
    assert s[toxic].min() > 0.5 > s[~toxic].max()


def test_quality_and_odd_rows(labelled):
    docs, labels = labelled
    model = quality_crf.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = quality_crf.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 != 1) for r in held) >= 0.97 * len(held)
    same = quality_crf.fit(docs, labels.filter("quality = 1"))
    assert len({r.score for r in quality_crf.score(docs, same).collect()}) == 1
    assert quality_crf.score(docs.limit(0), model).count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 5, 2]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    e, trans = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    p, moves = quality_crf.forward_backward(e, trans, starts)
    want, steps = np.zeros((11, 2)), np.zeros((2, 2))
    for a, n in zip(starts, sizes, strict=False):
        paths = [[(b >> i) & 1 for i in range(n)] for b in range(2**n)]
        w = np.array([np.exp(sum(e[a + i, y] for i, y in enumerate(x)) + sum(trans[u, v] for u, v in zip(x, x[1:], strict=False))) for x in paths])
        for x, q in zip(paths, w / w.sum(), strict=True):
            for i, y in enumerate(x):
                want[a + i, y] += q
            for u, v in zip(x, x[1:], strict=False):
                steps[u, v] += q
    assert np.allclose(p, want) and np.allclose(moves, steps)
