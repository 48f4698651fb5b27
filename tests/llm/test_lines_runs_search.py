"""Line dedup, periodic runs and ranked search, held against brute force on small awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ball_tree, line_dedup, lyndon, periodic_runs, ranked_search

SF001 = "/root/testdata/sf0.001"
STRIP = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- line dedup ------------------------------------------------------------------


def brute_lines(rows, least=10):
    """Per row (id, lines, lost, kept text); a null id is the largest."""
    big = (1, 0)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(STRIP))
            if len(key) >= least:
                own = big if i is None else (0, i)
                first[key] = min(first.get(key, own), own)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = big if i is None else (0, i)
        kept = [x for x in lines if first.get(lowered(x.strip(STRIP)), own) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(5)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "", "  ", "ÄÖÜ äöü ÄÖÜ é", "äöü", "日本語日本語日本語語"]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(pool)
            line = rng.choice([line, line.upper(), f"  {line}\t", f"\x0b{line} \r", line + "\xa0"])
            lines.append(line)
        rows.append((rng.randrange(40), "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, pool[0] + "\nonly a null id has this"), (None, pool[0] + "\nonly a null id has this")]
    rows += [(102, "\n".join(["the same long line"] * 200 + ["own line of 102 " + str(j) for j in range(300)]))]
    rows += [(103, "\n".join(["the same long line"] * 200 + ["own line of 103 " + str(j) for j in range(3)] * 100))]
    rows += [(104, "\n"), (104, "\n"), (105, "the same long line\n")]
    return rows


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_line_dedup_equals_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", group_rows)
    rows = line_rows()
    wanted = Counter((i, n, lost, digest(kept)) for i, n, lost, kept in brute_lines(rows))
    docs = spark.createDataFrame([(i, t, 1, [2], "x") for i, t in rows], "doc_id long, text string, pos int, keep array<int>, t1 string")
    assert Counter(tuple(r) for r in line_dedup.op13_query(docs.repartition(5)).collect()) == wanted
    whole = line_dedup.deduped(docs)
    assert whole.columns == docs.columns
    texts = {(i, t): kept for (i, t), (_, _, _, kept) in zip(rows, brute_lines(rows), strict=True)}
    got = Counter((r.doc_id, r.text, r.t1, r.pos) for r in whole.collect())
    assert got == Counter((i, t if t is None else texts[i, t], "x", 1) for i, t in rows)


def test_line_bitmaps_name_the_lines(spark):
    rows = [(1, "a shared line\nmine alone"), (2, "\n".join(["x"] * 70 + ["A SHARED LINE"]))]
    found = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.id, r.n_dropped, [(w.word, w.bits) for w in r.keep]) for r in found] == [(2, 1, [(1, ~(1 << 6))])]


def test_line_dedup_of_an_empty_table_and_without_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.op13_query(docs).collect() == []
    plan = line_dedup.op13_query(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_are_split_by_range_and_streamed_once(spark):
    lines = line_dedup.line_hashes(spark.read.parquet(f"{SF001}/documents.parquet"))
    salted = line_dedup._salted(lines).repartitionByRange("h1", "h2", "salt")
    from pyspark.sql import Window

    first = F.first("id").over(Window.partitionBy("h1", "h2", "salt").orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, 0))
    plan = salted.withColumn("first", first)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(h1" not in plan


# -- periodic runs ----------------------------------------------------------------


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        ends = [j for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))]
        out.append(ends[-1] - i)
    return out


def brute_runs(w, least=6, power=4):
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            part = w[i : i + size]
            if j > i and size >= max(least, power * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, s = rng.choice([1, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        s += [rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
    return s


def test_grouping_gives_the_lyndon_array():
    rng = random.Random(1)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 14))]
        assert lyndon.lyndon_array(np.array(s, np.int64)).tolist() == brute_lyndon(s)


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(800):
        s = random_words(rng)
        assert lyndon.runs(np.array(s, np.int64), 6, 4) == brute_runs(s)
        docs = [[b"%d" % x for x in s], [], [b"a"] * rng.randint(0, 9), [b"%d" % x for x in random_words(rng)]]
        assert periodic_runs.find_runs(docs) == [brute_runs(d) for d in docs]


def test_long_cycles_take_linear_time():
    for s in ([0] * 100_000, list(range(50_000)), list(range(1000)) * 100):
        lyndon.lyndon_array(np.array(s, np.int64))
    assert lyndon.runs(np.array(list(range(1000)) * 100, np.int64), 6, 4) == [(0, 100_000, 1000)]


def test_operator_twelve_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in random_words(rng))) for i in range(150)]
    rows += [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 90)))) for i in range(150, 300)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (None, "a " * 9), (7, rows[7][1]), (303, "a\x1ca\xa0a a " * 7), (304, "x y " * 9000)]
    wanted = Counter()
    for i, text in rows:
        words = WORDS.findall(text or "")
        words = [w.decode() for w in periodic_runs.planted_cycle(i, [w.encode() for w in words])]
        found = brute_runs(words) if len(words) < 5000 else [(0, len(words), 2)]
        lost = {j for s, n, q in found for j in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(w for j, w in enumerate(words) if j not in lost)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        wanted[(i, len(found), *head, digest(listed), digest(kept))] += 1
    assert sum(n for k, n in wanted.items() if k[1]) > 50
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, start int, runs string").repartition(4)
    assert Counter(tuple(r) for r in periodic_runs.op12_query(docs).collect()) == wanted
    assert periodic_runs.op12_query(docs.limit(0)).collect() == []


def test_planted_cycles_follow_their_rule():
    import zlib

    planted = 0
    for i in range(200):
        words = [b"%d" % j for j in range(i % 37)]
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        want = list(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        assert periodic_runs.planted_cycle(i, words) == want
    assert planted > 5


# -- ranked search -----------------------------------------------------------------


def brute_ranking(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counted = [(i, Counter(term.findall(lowered(t or "")))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(term.findall(lowered(t or "")))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in counted:
            if not c:
                continue
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scores[:top], 1)]
    return out


def search_rows():
    rng = random.Random(7)
    vocabulary = [f"w{int(abs(rng.gauss(0, 60)))}" for _ in range(300)] + ["É", "é", "日本", "A1b", "x_y", "it's"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(80)] + [(3, docs[3][1]), (3, "w1 w2"), (None, docs[9][1]), (500, None), (501, ""), (502, "...")]
    docs += [(503, "w1 " * 20_000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    items += [(40, docs[5][1]), (41, None), (42, ""), (43, "nowhere at all"), (1, "w7 É"), (None, "w3 w4")]
    return docs, items


@pytest.mark.parametrize(("top", "tree"), [(50, 4096), (7, 64)])
def test_ranking_equals_brute_force(spark, monkeypatch, top, tree):
    monkeypatch.setattr(ranked_search, "TREE_DOCS", tree)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 20)
    docs, items = search_rows()
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, id string").repartition(3)
    wanted = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranked_search.ranked_search(table, wanted, top).collect()]
    assert sorted(got, key=repr) == sorted(brute_ranking(docs, items, top), key=repr)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, i in ((docs, items), (full, items), (docs, one)):
        found = ranked_search.op11_query(d, i)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_ball_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    n, size = 600, 200
    dense = (rng.random((n, size)) < 0.05) * rng.integers(1, 10**6, (n, size))
    dense[300:, :100] = 0
    dense[:300, 100:] = 0
    rows, dims = np.nonzero(dense)
    vectors = ball_tree.Vectors(np.bincount(rows, minlength=n), dims, dense[rows, dims])
    groups = ball_tree.dimension_groups((dense > 0).sum(0))
    tree = ball_tree.BallTree(vectors, size, groups)
    weights = np.where(rng.random((20, size)) < 0.1, rng.integers(0, 20000, (20, size)), 0)
    lengths = ball_tree.query_lengths(weights, groups)
    limit, scores = tree.bounds(weights, lengths), dense @ weights.T
    for node, own in enumerate(tree.rows):
        assert (scores[own].max(0) <= limit[node]).all()
    query, row, score = tree.search(weights, lengths, np.ones(20, np.int64), 5)
    for q in range(20):
        best = np.sort(scores[:, q])[::-1][:5]
        assert np.sort(score[query == q])[::-1][:5].tolist() == best[best > 0].tolist()
        assert (scores[row[query == q], q] == score[query == q]).all()
