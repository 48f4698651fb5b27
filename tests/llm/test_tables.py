"""Operators over whole tables: Jaccard join, vector search, WARC audit, mixing, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import ann_forest, exact_topk, jaccard_join, mixing, warc_audit
from skein.llm.components import connected_components

SF001 = "/root/testdata/sf0.001"


# -- components -------------------------------------------------------------------


def smallest_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == smallest_reachable(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


# -- Jaccard join -------------------------------------------------------------------


def word_sets(text, width):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, p, q):
    own = [(i, word_sets(t, width)) for i, t in rows]
    links, postings = [], defaultdict(list)
    for k, (i, x) in enumerate(own):
        common = Counter(j for g in x for j in postings[g])
        for g in x:
            postings[g].append(k)
        links += [(i, own[j][0]) for j, c in common.items() if i is not None and own[j][0] is not None
                  and q * c >= p * (len(x) + len(own[j][1]) - c)]
    root = smallest_reachable({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(x), root.get(i)) for i, x in own), key=repr)


def family_rows(seed, n):
    rng = random.Random(seed)
    bases = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(k)) for k in (40, 120, 300, 700)]
    rows = []
    for i in range(n):
        words = rng.choice(bases).split()
        for _ in range(rng.randint(0, 5)):
            k, what = rng.randrange(len(words)), rng.random()
            if what < 0.5:
                words[k] = f"e{rng.randint(0, 10**6)}"
            elif what < 0.75:
                words.insert(k, f"f{rng.randint(0, 10**6)}")
            else:
                del words[k]
        if rng.random() < 0.2:  # a common passage and words of its own
            words = rng.choice(bases).split()[:25] + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(words)))
    return rows


ODD = [(1000, ""), (1001, None), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, "a\tB"), (1006, "a b c"),
       (1007, " \n"), (1008, "é È"), (1009, "é È"), (1010, "é è"), (None, "a b c"), (None, ""), (1011, "p q r s"),
       (1011, "x y z"), (1012, "p q r s"), (1013, "x y z"), (1014, "go " * 50_000), (1015, "go " * 9)]


@pytest.mark.parametrize(("width", "p", "q"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components_equal_brute_force(spark, width, p, q):
    rows = family_rows(width, 300) + ODD
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, n int, rep string")
    got = jaccard_join.similarity_components(docs.repartition(3), width, Fraction(p, q)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, width, p, q)


def test_jaccard_with_spread_shingles_and_small_packets(spark, monkeypatch):
    """The order of shingles must not change the links, whichever shingles it puts last."""
    rows = family_rows(11, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "SPREAD", 2)
    monkeypatch.setattr(jaccard_join, "SPREAD_SHINGLES", 300)
    got = jaccard_join.similarity_components(docs, 3, Fraction(9, 10)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 3, 9, 10)
    shingles, counts = jaccard_join.spread_shingles(docs, 3)
    assert len(shingles) <= 300 and (np.diff(shingles.astype(np.int64)) > 0).all() and counts.min() >= 2


def several_texts():
    """Texts of ids that are repeated: edited copies of equal size, texts without words, and three families in a chain."""
    rng = random.Random(21)
    bases = [[f"b{k}w{j}" for j in range(60)] for k in range(9)]

    def edited(k):
        words = list(bases[k])
        words[rng.randrange(5, 55)] = f"e{rng.randint(0, 10**6)}"
        return " ".join(words)

    rows = [(100 + 10 * k + i, edited(k)) for k in range(9) for i in range(4)]
    rows += [(0, edited(0)), (0, edited(1)), (0, edited(0))]  # two of family 0: one may be absorbed by the other
    rows += [(1, edited(2)), (1, None), (1, ""), (1, edited(2))]  # the smallest id: left in every pair
    rows += [(500, edited(3)), (500, edited(4)), (500, edited(5)), (500, "alone in the world")]
    rows += [(501, bases_end(bases[6], "x")), (501, edited(7)), (502, bases_end(bases[6], "y")), (502, edited(7))]
    return rows + [(503, edited(8))] * 3 + [(504, edited(8)), (504, edited(8)), (504, None)]


def bases_end(words, end):
    return " ".join([*words[:-1], end])  # most of its prefix is its family's


@pytest.mark.parametrize(("width", "p", "q"), [(3, 9, 10), (5, 4, 5), (2, 19, 20)])
def test_jaccard_of_ids_with_several_texts(spark, width, p, q):
    rows = several_texts()
    random.Random(width).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similarity_components(docs.repartition(3), width, Fraction(p, q)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, width, p, q)


def test_margin_of_the_short_form_grows_with_the_sets(spark):
    """Pairs just below the threshold, with as many false matches of 32-bit halves as a draw may have."""
    rng, rows = np.random.default_rng(9), []
    for n in (100, 20_000, 500_000, 1_000_000, 10_000_000):
        apart = -(-n // 19) + 1  # of n shingles each: (n - apart) / (n + apart) is just below 9 / 10
        assert 10 * (n - apart) < 9 * (n + apart)
        rows += [(n - apart + int(more), n, n) for more in rng.poisson(apart * n / 2**32, 300)]
    pairs = spark.createDataFrame(rows, "both long, n_a long, n_b long")
    linked = pairs.where("both * 19 >= 9 * (n_a + n_b)")
    assert linked.where("n_a = 1000000").count() > 200  # by the short form alone
    assert linked.where(f"not {jaccard_join.doubtful(9, 10)}").count() == 0
    clear = spark.createDataFrame([(98, 100, 100), (19_900, 20_000, 20_000), (990_000, 10**6, 10**6)], pairs.schema)
    assert clear.where(jaccard_join.doubtful(9, 10)).count() == 0


def test_jaccard_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.op7_query(empty).count() == 0


# -- vectors --------------------------------------------------------------------------


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dim)) / 4


AWKWARD_VECTORS = [(None, [1.0, 2.0]), (9001, None), (9002, []), (9003, [1.0, None]), (9004, [float("nan"), 1.0]),
                   (9005, [float("inf"), 1.0]), (9050, [3.0, 4.0]), (9100, [3.0, 4.0]), (9101, [3.0, 4.0]),
                   (9101, [3.0, 4.0]), (9102, [-0.3, 0.1]), (9150, [0.0, 0.0])]


def vector_table(spark, n=450, dim=16):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(n, dim, 1))]
    rows += [(8001 + i, rows[100][1]) for i in range(20)]  # copies of a query's vector: ties
    rows += AWKWARD_VECTORS
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int"), rows


def taking_part(rows, zero):
    own = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        own[i] = min(own.get(i, v), v)
    return own


def test_exact_top_k_equals_brute_force(spark):
    table, rows = vector_table(spark)
    own = {i: [math.floor(1024 * x) for x in v] for i, v in taking_part(rows, True).items()}
    want = []
    for q in (i for i in own if i % 100 == 0):
        scored = [(-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q and len(v) == len(own[q])]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:10])]
    got = [tuple(r) for r in exact_topk.op2_query(table.repartition(4)).collect()]
    assert sorted(got) == sorted(want)
    assert exact_topk.op2_query(table.limit(0)).count() == 0


def test_ids_with_several_vectors_count_with_the_best(spark, monkeypatch):
    """Every row is a candidate, whatever id it shares; a zero vector doesn't hide the others of its id."""
    monkeypatch.setattr(exact_topk, "CANDIDATE_ROWS", 100)
    monkeypatch.setattr(ann_forest, "CANDIDATE_ROWS", 100)
    own = np.round(vectors(400, 6, 8), 3)
    rows = [(i // 2 if i < 300 else 7, [float(x) for x in v]) for i, v in enumerate(own)]  # a quarter is id 7
    rows += [(900, [0.0] * 6), (900, rows[4][1]), (901, rows[200][1]), (901, rows[200][1]), (100, [0.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def brute(score, queries, k):
        out = []
        for q in queries:
            top = {}
            for x in (v for i, v in rows if i == q):
                for i, v in rows:
                    if i != q and (s := score(np.array(x), np.array(v))) is not None:
                        top[i] = max(top.get(i, s), s)
            order = sorted(top, key=lambda i: (-round(top[i], 12), i))[:k]
            out += [(q, r + 1, i, top[i]) for r, i in enumerate(order)]
        return sorted(out)

    def whole(x, v):
        return int(np.floor(1024 * x).astype(int) @ np.floor(1024 * v).astype(int))

    def cosine(x, v):
        return float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)) if x.any() and v.any() else None

    got = sorted(tuple(r) for r in exact_topk.op2_query(table).collect())
    assert got == brute(whole, (0, 100, 900), 10)
    got = sorted(tuple(r) for r in ann_forest.nearest(table, "id in (7, 100, 900)", candidate_share=1.0).collect())
    want = brute(cosine, (7, 100, 900), 5)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want))


def test_branch_and_bound_is_exact_for_large_numbers():
    rng = np.random.default_rng(7)
    for top in (10, 1 << 28):  # doubles, then 64-bit integers
        c = rng.integers(-top, top, (24, 300))
        q = rng.integers(-top, top, (24, 5))
        ids = np.arange(300)
        for j, (at, score) in enumerate(exact_topk.search(q, c, np.array([-1, 0, 1, 2, 3]), ids, 7)):
            exact = [sum(int(a) * int(b) for a, b in zip(q[:, j], c[:, i])) for i in range(300)]
            order = sorted((i for i in range(300) if i != j - 1), key=lambda i: (-exact[i], i))[:7]
            assert at.tolist() == order and score.tolist() == [exact[i] for i in order]


def test_forest_recall_and_exact_scores(spark):
    table, rows = vector_table(spark, 3_000, 16)
    own = taking_part(rows, False)
    found = defaultdict(dict)
    for r in ann_forest.nearest(table.repartition(4), "id % 50 = 0", least_candidates=200, candidate_share=0.2).collect():
        found[r["query_id"]][r["vec_id"]] = (r["rank"], r["score"])
    hit = total = 0
    for q, x in ((i, np.array(v)) for i, v in own.items() if i % 50 == 0):
        same = {i: np.array(v) for i, v in own.items() if i != q and len(v) == len(x)}
        cos = {i: float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v))) for i, v in same.items()}
        best = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        assert len(found[q]) == len(best)
        hit, total = hit + len(found[q].keys() & set(best)), total + len(best)
        assert all(abs(score - cos[i]) < 1e-12 for i, (_, score) in found[q].items())
        assert sorted(rank for rank, _ in found[q].values()) == list(range(1, len(best) + 1))
    assert hit / total >= 0.9
    assert ann_forest.op4_query(table.limit(0)).count() == 0


def test_forest_gives_ties_to_the_smallest_ids(spark):
    table, _ = vector_table(spark)
    found = [r for r in ann_forest.op4_query(table.repartition(4)).collect() if r["query_id"] == 100]
    assert sorted((r["rank"], r["vec_id"]) for r in found) == [(k, 8000 + k) for k in range(1, 6)]
    # ties at the k-th place, with better ones before them and ids that are not in the order of the table
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(200, 8, 2))]
    rows += [(1000 - i, rows[50][1]) for i in range(2)] + [(900 - i, [2 * rows[50][1][0], *rows[50][1][1:]]) for i in range(60)]
    found = ann_forest.op4_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [r["vec_id"] for r in sorted(found.where("query_id = 50").collect(), key=lambda r: r["rank"])]
    assert got[:2] == [999, 1000] and got[2:] == [841, 842, 843]


def test_copies_of_one_vector_do_not_end_the_search(spark):
    own = vectors(1_200, 16, 5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(own)]
    near = [float(x) for x in own[50] + vectors(1, 16, 6)[0] / 8]  # shares long prefixes with query 50
    rows += [(10_000 + i, near) for i in range(1_000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann_forest.nearest(table, "id = 50", 1_100, least_candidates=100).collect()
    assert sum(r["vec_id"] >= 10_000 for r in found) == 1_000
    assert sum(r["vec_id"] < 10_000 for r in found) == 100
    found = ann_forest.nearest(table, "id = 50", 2_300, least_candidates=100).collect()
    assert sum(r["vec_id"] < 10_000 for r in found) >= 0.3 * 1_200 - 2


def test_gather_finds_the_longest_prefixes_first():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << ann_forest.BITS, (1, 500)).astype(np.uint32)
    order = np.argsort(own, axis=1)
    asked = np.array([own[0, 17] ^ 1], np.uint32)
    first, behind = ann_forest.descend(asked[:, None], np.take_along_axis(own, order, 1))
    seen = ann_forest.gather(first[:, :, 0], behind[:, :, 0], order, 9)
    common = [ann_forest.BITS - int(x ^ asked[0]).bit_length() for x in own[0].tolist()]
    level = min(c for c, s in zip(common, seen) if s)
    assert seen.sum() >= 9 and all(s == (c >= level) for c, s in zip(common, seen))


# -- WARC audit ------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_audit_finds_what_differs(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "RANGE_BYTES", 1 << 10)
    monkeypatch.setattr(warc_audit, "ARCHIVE_BYTES", 1 << 16)
    rows = [(i, f"http://h/{i}", "<p>" + "é" * (i % 50)) for i in range(900)]
    rows += [(901, None, None), (None, "u", ""), (902, "big", "y" * 300_000)] + [(903, "same", "same")] * 40
    pages = spark.createDataFrame(rows, PAGES)
    placed = warc_audit.addressed(warc_audit.records(pages)).persist()
    own = placed.orderBy("archive", "offset").collect()
    assert len(own) == len(rows)
    at = 0
    for r in own:  # one after the other, without holes
        assert r["archive"] * (1 << 16) + r["offset"] == at
        at += r["length"]
    assert warc_audit.audit(placed, placed).count() == 0
    other = placed.where("not coalesce(key, 0) in (5, 902)")
    other = other.withColumn("digest", F.when(F.col("key") == 700, F.lit("bad")).otherwise(F.col("digest")))
    new = spark.createDataFrame([(77, "d", 9, 10**6, 3)], other.schema)
    got = sorted((r["key"], r["status"]) for r in warc_audit.audit(placed, other.unionByName(new)).collect())
    assert got == [(5, "missing"), (77, "extra"), (700, "altered"), (902, "missing")]
    empty = placed.limit(0)
    assert warc_audit.audit(empty, empty).count() == 0 and warc_audit.audit(empty, placed).count() == len(rows)


def test_roots_equal_hashes_made_by_hand(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "RANGE_BYTES", 512)
    monkeypatch.setattr(warc_audit, "ARCHIVE_BYTES", 512 * 64)
    pages = spark.createDataFrame([(i, f"u{i}", "z" * i) for i in range(100)], PAGES)
    placed = warc_audit.addressed(warc_audit.records(pages)).persist()
    level = defaultdict(list)
    for r in placed.orderBy("archive", "offset").collect():
        body = "z" * r["key"]
        data = (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: u{r['key']}\r\nContent-Type: text/html\r\n"
                f"Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n")  # fmt: skip
        assert r["length"] == len(data) and r["digest"] == hashlib.sha256(data.encode()).hexdigest()
        level[r["archive"], r["offset"] // 512].append(f"{r['offset']}:{r['digest']}")
    for _ in range(warc_audit.levels() + 1):
        nodes = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in level.items()}
        level = defaultdict(list)
        for (archive, node), digest in sorted(nodes.items()):
            level[archive, node // warc_audit.FANOUT].append(f"{node}:{digest}")
    got = warc_audit.tree(placed).where(F.col("level") == warc_audit.levels()).collect()
    assert {(r["archive"], r["node"]): r["digest"] for r in got} == nodes


# -- mixing ------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, p string"


def mixed_rows():
    rng = random.Random(8)
    rows = []
    for i in range(2_000):
        source = rng.choice(["a"] * 6 + ["b", "c", None])
        rows.append((i, "w " * rng.randint(1, 900), rng.choice(["en", "en", "de", None]), source, "x"))
    return rows + [(None, "w w", "en", "a", ""), (5000, None, "en", "a", ""), (5001, "", "zz", "empty", "")]


def test_raked_weights_meet_all_three_targets(spark):
    docs = spark.createDataFrame(mixed_rows(), DOCS)
    own = mixing.mixed(docs, mixing.POWERS, 0.5).persist()
    assert own.count() == docs.count()
    cells = own.groupBy(*mixing.MARGINALS).agg(F.sum("tokens").alias("tokens"))
    targets = {c: mixing.smoothed(cells, c, mixing.POWERS[c]) for c in mixing.MARGINALS}
    raked = mixing.rake(cells, targets).collect()
    for c in mixing.MARGINALS:
        want = {r["value"]: r["target"] for r in targets[c].collect()}
        have = defaultdict(float)
        for r in raked:
            have[r[c]] += r["weight"]
        assert sum(want.values()) == pytest.approx(1)
        assert all(abs(have[v] - t) < 1e-6 for v, t in want.items())
    # expected tokens meet the budget, decisions follow the probabilities
    rows = own.collect()
    total = sum(r["tokens"] for r in rows)
    assert sum(r["tokens"] * r["p"] for r in rows) == pytest.approx(0.5 * total, rel=1e-6)
    assert sum(r["tokens"] for r in rows if r["kept"]) == pytest.approx(0.5 * total, rel=0.1)
    assert all(0 <= r["p"] <= 1 for r in rows)
    none = {r["doc_id"]: r for r in rows if r["doc_id"] in (None, 5001)}
    assert none[5001]["p"] == 0 and not none[5001]["kept"] and not none[None]["kept"]


def test_mixing_of_an_empty_table_and_of_texts_without_words(spark):
    docs = spark.createDataFrame(mixed_rows(), DOCS)
    assert mixing.op1_query(docs.limit(0)).count() == 0
    rows = mixing.op1_query(docs.where("doc_id >= 5000")).collect()
    assert len(rows) == 2 and not any(r["kept"] for r in rows)


def test_mixing_plans_have_no_python(spark):
    docs = spark.createDataFrame(mixed_rows()[:50], DOCS)
    plan = mixing.op1_query(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- pipeline -----------------------------------------------------------------------------


def test_every_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights",
        "BPE encoding and decoding",
    ]
    kept = corpus_pipeline.keep_quality(spark, docs, SF001).persist()
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert np.mean([(i in ids) == q for i, q in labels.items()]) > 0.95
    unique = corpus_pipeline.drop_near_duplicates(spark, kept, SF001).persist()
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {i for i, _, c in brute_components(before, 5, 4, 5) if i == c}
    assert {r["doc_id"] for r in unique.collect()} == want
    leak = spark.createDataFrame([(10**6, f"key {'0af3' * 8} and AKIA{'Q7' * 8}", "en", "s", 60)], docs.select(*corpus_pipeline.COLUMNS).schema)
    clean = corpus_pipeline.remove_secrets(spark, unique.unionByName(leak), SF001).persist()
    assert {r["doc_id"] for r in clean.collect()} == want | {10**6}
    assert clean.where(f"doc_id = {10**6}").first()["text"] == "key [SECRET] and [SECRET]"
    assert clean.join(unique, ["doc_id", "text"]).count() >= unique.count() - 2
    sample = corpus_pipeline.mix_sources(spark, clean, SF001).persist()
    assert 0 < sample.count() < clean.count()
    for stage in (kept, unique, clean, sample):
        assert stage.columns == docs.columns
    tokens = corpus_pipeline.encode_tokens(spark, sample, SF001).join(sample.select("doc_id", "text"), "doc_id")
    assert tokens.count() == sample.count()
    assert all(r["decoded"] == r["text"] and r["n_tokens"] == len(r["ids"]) for r in tokens.collect())


def test_run_equals_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == docs.columns
    assert sorted(r["ids_sha256"] for r in got.collect()) == sorted(r["ids_sha256"] for r in docs.collect())


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, redacted int, topic string, _source string, __source string, ids int, row string, found int, key string, body string, c0 string, r0 int"


def clashing_rows():
    """Documents with columns that bear names of results and internal columns, repeated rows, null ids, awkward texts."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(2, 7) for _ in range(n))
    texts = [prose(60) for _ in range(20)] + [f"{prose(20)} password = hunter{'2' * 9} end"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(i, t) for i, t in rows[:12]] + rows[:3]  # repeated rows
    rows += [(None, texts[4]), (None, texts[4]), (None, prose(50)), (50, None), (50, None), (51, ""), (None, None)]
    rows += [(60, rows[7][1] + " end"), (61, "x " * 30_000), (62, "x " * 30_000)]
    lone = prose(55)
    rows += [(None, lone), (None, lone), (None, lone + " more")]
    return [(i, t, "en", f"s{n % 3}", len(t or ""), 0.5, "s", 1, "t", "u", "v", 2, "w", 3, "k", "b", "c", 4) for n, (i, t) in enumerate(rows)]


def test_stages_pass_clashing_columns_and_collapse_repeated_rows(spark):
    rows = clashing_rows()
    docs = spark.createDataFrame(rows, CLASHING)
    from skein.llm import quality, secrets

    def values(df):
        assert df.columns == docs.columns
        return Counter(tuple(r) for r in df.collect())

    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert values(quality.accepted(docs, model, 0.0)) == Counter(rows)
    kept = jaccard_join.representatives(docs)
    got = values(kept)
    # all repeats are gone, null ids among them; near copies go to the smaller id, a null one last
    assert max(Counter((r[0], r[1]) for r in got.elements()).values()) == 1
    texts = Counter(r[1] for r in got.elements())
    assert texts[rows[4][1]] == 1 and {r[0] for r in got.elements() if r[1] == rows[4][1]} == {4}
    ids = {r[0] for r in got.elements()}
    assert ids == {*range(21), 50, 51, 61, None}
    nameless = sorted(len((r[1] or "").split()) for r in got.elements() if r[0] is None)
    assert nameless in ([0, 50, 55], [0, 50, 56])  # of near copies without ids either stays
    clean = secrets.redacted(kept)
    changed = {r[0]: r for r in values(clean).elements()}
    assert "hunter" not in changed[20][1] and changed[20][4] == len(changed[20][1])
    assert sum(r[1] == changed[r[0]][1] for r in got.elements() if r[0] is not None) == len(ids) - 2
    mixed = mixing.mixed(clean, mixing.POWERS, mixing.BUDGET)
    assert set(docs.columns) <= set(mixed.columns) and mixed.count() == sum(got.values())
    empty = docs.limit(0)
    assert jaccard_join.representatives(empty).collect() == secrets.redacted(empty).collect() == []


def test_pipeline_of_an_empty_table_and_of_null_ids(spark, tmp_path):
    for name, rows in (("empty", []), ("odd", clashing_rows())):
        folder = tmp_path / name
        spark.createDataFrame(rows, CLASHING).write.parquet(f"{folder}/documents.parquet")
        labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
        labels.where("true" if rows else "false").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, str(folder))
        assert "n_tokens" in got.columns and (got.count() > 0) == bool(rows)
