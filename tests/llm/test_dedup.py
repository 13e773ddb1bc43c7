import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import chosen_path, common, compact_windows, exact_dedup, line_dedup
from marginalia.llm.shingles import shingle_set, shingles, words

CLASHES = ["_gone", "_same", "_key", "_id", "_cuts", "_new", "_spans", "_score", "own_id", "own_key", "_part", "key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, sig long, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, *CLASHES) for i, t in texts], SCHEMA)


def union(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [None, "", "  ", "one", "ONE two", "a b c d", "a b c d", "A  b c d", "x" * 20_000, prose(rng, 6000)]
    hot = prose(rng, 120)
    texts += [hot] * 40 + [hot.replace(" ", "  ", 1)] * 3
    for _ in range(12):  # families of near copies
        base = prose(rng, 150).split()
        for _ in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    near = prose(rng, 100).split()
    for i in range(60):  # one large family
        own = list(near)
        own[i] = f"y{i}"
        texts.append(" ".join(own))
    passage, line = prose(rng, 70), prose(rng, 9)
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 40)}" for _ in range(8)]
    texts += [f"{line}\n{prose(rng, 80)}" for _ in range(40)]
    return [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(20, hot), (9, texts[9])]


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_exact(spark, corpus):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in corpus]
    groups = defaultdict(list)
    for (i, _), n in zip(corpus, norm, strict=True):
        groups[n].append(i)
    for budget in (exact_dedup.BUDGET, 3000):
        got = exact_dedup.exact_groups(table(spark, corpus).repartition(5), budget).collect()
        assert len(got) == len(corpus)
        assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == sorted(
            str((i, min((x for x in groups[n] if x is not None), default=None), len(groups[n]), hashlib.sha256(n.encode()).hexdigest())) for (i, _), n in zip(corpus, norm, strict=True)
        )
        kept = [r["text_sha256"] for r in got if r["kept"]]
        assert len(kept) == len(set(kept)) == len(groups)
    staged = exact_dedup.stage(spark, table(spark, corpus), "")
    assert staged.columns == table(spark, corpus).columns and staged.count() == len(groups)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=30))
def test_trie(keys):
    trie, want = exact_dedup.RadixTrie(), {}
    for k in keys:
        node = trie.node(k)
        node.value = (node.value or 0) + 1
        want[k] = want.get(k, 0) + 1
    found = {}
    while part := dict(trie.spill()):
        assert not set(part) & set(found)
        found |= part
    found |= dict(trie.terminals(trie.root))
    assert found == want


def test_jaccard_join(spark, corpus):
    sets = [shingle_set(t or "") for _, t in corpus]
    first: dict = {}
    for (i, _), s in zip(corpus, sets, strict=True):
        if len(s):
            first.setdefault(s.tobytes(), []).append(i)
    reps = sorted((min((x for x in v if x is not None), default=10**9), np.frombuffer(k, np.uint64)) for k, v in first.items())
    links = [(a, b) for a in range(len(reps)) for b in range(a) if jaccard(reps[a][1], reps[b][1]) >= 0.8]
    root = union(len(reps), links)
    degree = [sum(x in pair for pair in links) for x in range(len(reps))]
    place = {s.tobytes(): i for i, (_, s) in enumerate(reps)}
    for small in (chosen_path.SMALL, 8):  # with and without splitting of buckets
        got = chosen_path.jaccard_links(table(spark, corpus), small=small, block=16).collect()
        assert len(got) == len(corpus)
        want = []
        for (i, _), s in zip(corpus, sets, strict=True):
            if len(s):
                p = place[s.tobytes()]
                want.append((i, reps[root[p]][0] if reps[root[p]][0] < 10**9 else None, degree[p], len(first[s.tobytes()])))
            else:
                want.append((i, i, 0, 1))
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"])) for r in got)
    staged = chosen_path.stage(spark, table(spark, corpus), "")
    assert staged.columns == table(spark, corpus).columns
    assert {r["doc_id"] for r in staged.collect()} == {w[0] for w in want if w[0] == w[1]} | {None}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z_9\n-éß中文字、ひカ🙂한"), max_size=30), min_size=1, max_size=6))
def test_words(texts):
    from marginalia.llm.shingles import words_of

    for t, (hashes, begins, ends) in zip(texts, words_of(texts), strict=True):
        raw = t.encode()
        want = re.findall(r"[\u3000-\u9fff]|(?:[A-Za-z0-9_]|[^\x00-\x7f\u3000-\u9fff])+", t)
        assert [raw[a:z].decode() for a, z in zip(begins, ends, strict=True)] == want
        assert [int(words(w.encode())[0][0]) for w in want] == hashes.tolist()


def test_texts_without_spaces(spark):
    rng = random.Random(7)
    one = [chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(400)]
    other = list(one)
    other[200] = "一"
    texts = [(1, "".join(one)), (2, "".join(other)), (3, "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(300)) + "".join(one[50:150]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_links(table(spark, texts)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    found = {(r["doc_id"], r["source_doc_id"]): r["n_words"] for r in compact_windows.repeated_passages(table(spark, texts)).collect()}
    assert found.keys() == {(2, 1), (3, 1)} and found[3, 1] == 100


def test_shared_counts_in_strips():
    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 300, 100).astype(np.uint64)) for _ in range(20)]
    want = np.array([[len(np.intersect1d(a, b)) for b in lists] for a in lists])
    off = ~np.eye(20, dtype=bool)
    for cells in (1 << 23, 5000):
        assert (chosen_path.shared_counts(lists, cells)[off] == want[off]).all()


def test_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(1)
    for ties, values in ((False, rng.permutation(120)), (True, rng.integers(0, 6, 120))):
        found = compact_windows.windows(values.astype(np.uint64), ties, 10)
        for i in range(120):
            for j in range(i + 9, 120):
                own = [c for a, c, z in found if a <= i <= c <= j <= z]
                assert len(own) == 1 and values[own[0]] == values[i : j + 1].min()


def test_passages(spark, corpus):
    got = compact_windows.repeated_passages(table(spark, corpus)).collect()
    spans = defaultdict(list)
    for r in got:
        assert r["source_doc_id"] < r["doc_id"] and r["n_words"] >= 50 and r["similarity"] >= 0.8
        spans[r["doc_id"]].append((r["start"], r["end"]))
    seen: dict = {}
    clean = 0
    for i, text in sorted(((i, t or "") for i, t in corpus[:-2] if i is not None)):
        raw = text.encode()
        w, begins, ends = words(raw)
        runs = shingles(w, 50).tolist() if len(w) >= 50 else []
        covered = np.zeros(len(raw) + 1, bool)
        for a, z in spans.get(i, ()):
            covered[a:z] = True
        for k, h in enumerate(runs):
            if h in seen:
                assert covered[begins[k] : ends[k + 49]].mean() > 0.9  # the leader of a large family may differ from all others at an edge
            else:
                seen[h] = i
        clean += not spans.get(i)
    assert clean > 40
    staged = {r["doc_id"]: r for r in compact_windows.stage(spark, table(spark, corpus), "").collect()}
    for i, text in corpus:
        if i is not None and not spans.get(i):
            assert staged[i]["text"] == text
    assert all(r["n_chars"] == len(r["text"]) for r in staged.values() if r["text"] is not None)


def test_exact_passages_whose_words_stand_earlier_too():
    rng = random.Random(6)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    for n in (100, 40):
        a, b, c = own(30), own(30), own(n)
        leader, later = (compact_windows.Prepared(" ".join(t)) for t in (a + b + a + c, own(20) + a + c + own(20)))
        (got,) = compact_windows.passages(later, leader, (0, 10**6), (0, 10**6))
        assert got[2:] == (20, 20 + 30 + n - 5, 30 + n, 1.0)
    one, two = own(50), own(55)  # in the other order, between other words
    leader, later = (compact_windows.Prepared(" ".join(t)) for t in (two + own(70) + one, one + two))
    assert sorted(f[2:] for f in compact_windows.passages(later, leader, (0, 10**6), (0, 10**6))) == [(0, 45, 50, 1.0), (50, 100, 55, 1.0)]


def test_repeat_of_an_explained_text(spark):
    """Texts that repeat a passage of one which is itself a near copy of the smallest, where they differ from that one."""
    rng = random.Random(21)
    texts, want = [], []
    for f in range(30):
        one = [f"u{rng.randrange(10**6)}" for _ in range(300)]
        other = list(one)
        for k in (20, 130, 170, 220, 280):
            other[k] = f"t{rng.randrange(10**6)}"
        texts += [(10 * f, " ".join(one)), (10 * f + 1, " ".join(other)), (10 * f + 2, " ".join([f"r{rng.randrange(10**6)}" for _ in range(60)] + other[125:175] + [f"r{rng.randrange(10**6)}" for _ in range(60)]))]
    got = {(r["doc_id"], r["source_doc_id"]): r["n_words"] for r in compact_windows.repeated_passages(table(spark, texts)).collect()}
    for f in range(30):
        assert (10 * f + 1, 10 * f) in got and got[10 * f + 2, 10 * f + 1] >= 50


def test_near_repetitions_in_a_large_band(spark):
    rng = random.Random(5)
    texts = []
    for f in range(60):
        one = [f"b{rng.randrange(10**6)}" for _ in range(150)]
        other = list(one)
        other[60], other[90] = f"c{f}", f"d{f}"
        texts += [(2 * f, " ".join(one)), (2 * f + 1, " ".join(other))]
    rows = spark.createDataFrame([(7, 1, i, i, 70) for i, _ in texts], "band long, side int, uid long, doc long, c int")
    got = {(r["uid"], r["lead"]) for r in compact_windows.nearest(rows, spark.createDataFrame(texts, "uid long, text string"), block=50).collect()}
    assert got == {(2 * f + 1, 2 * f) for f in range(60)}


def test_near_passages(spark):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(120)]
    other = list(passage)
    other[30], other[80] = "new", "words"
    texts = [(1, f"{prose(rng, 50)} {' '.join(passage)} {prose(rng, 50)}"), (2, f"{prose(rng, 30)} {' '.join(other)} {prose(rng, 60)}"), (3, prose(rng, 200, 10**6))]
    got = compact_windows.repeated_passages(table(spark, texts)).collect()
    assert [(r["doc_id"], r["source_doc_id"]) for r in got] == [(2, 1)]
    text = texts[1][1]
    assert text[got[0]["start"] : got[0]["end"]].split()[0] == "p0" and text[got[0]["start"] : got[0]["end"]].split()[-1] == "p119"


def line_set(line):
    low = line.strip(" \t\r\x0b\x0c").lower()
    return low, {low[i : i + 8] for i in range(len(low) - 7)} or {low}


def test_lines(spark):
    rng = random.Random(4)
    common_line, long_line = "This line stands in very many documents indeed.", prose(rng, 60)
    texts = [(1, None), (2, ""), (3, "\n \n"), (None, "no id"), (4, "x" * 30_000)]
    texts += [(i, f"{prose(rng, 15)}\n{common_line}\n{prose(rng, 50)}\n  {common_line.upper()} ") for i in range(10, 40)]
    texts += [(i, long_line.replace(" ", f" q{i} ", 1)) for i in range(40, 60)] + [(60, "short"), (61, "short"), (61, "short"), (62, "Thiss line stands in very many documents indeed.")]
    texts += [(70, "He " * 400), (71, "He " * 90)]
    got = line_dedup.kept_lines(table(spark, texts)).collect()
    lines = sorted((10**9 if i is None else i, k, *line_set(x)) for i, t in texts for k, x in enumerate((t or "").split("\n")))
    assert len(got) == len(lines)
    first: dict = {}
    for i, k, low, sets in lines:
        if low:
            first.setdefault(low, (i, k, sets))
    own = list(first.items())
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = union(len(own), [(a, b) for a in range(len(own)) for b in range(a) if alike(own[a][1][2], own[b][1][2])])
    best: dict = {}
    for r, (_, (i, k, _)) in zip(root, own, strict=True):
        best[r] = min(best.get(r, (i, k)), (i, k))
    keep = {low: best[r] for r, (low, _) in zip(root, own, strict=True)}
    want = sorted((i, k, *(keep[low] if low else (i, k))) for i, k, low, _ in lines)
    none = lambda x: 10**9 if x is None else x
    assert sorted((none(r["doc_id"]), r["line_no"], none(r["keep_doc_id"]), r["keep_line_no"]) for r in got) == want
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["keep_doc_id"], r["keep_line_no"])) for r in got if r["doc_id"] is not None)


def test_long_lines_by_all_runs(spark):
    """Long lines of no or few spaces that only begin alike are all kept; their near copies are not."""
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    alone = [f"begins alike {own(200)}" for _ in range(5)] + [f"see https://exam{own(200)}" for _ in range(5)] + [f"data:image/png;base64,{own(130)}" for _ in range(5)]
    far = own(400)
    texts = [(i, t) for i, t in enumerate(alone)] + [(50, far), (51, far[:200] + "-" + far[200:]), (52, "\t".join(far[i : i + 9] for i in range(0, 400, 9)))]
    got = {r["doc_id"]: (r["kept"], r["keep_doc_id"]) for r in line_dedup.kept_lines(table(spark, texts)).collect()}
    assert got == {**{i: (True, i) for i in range(15)}, 50: (True, 50), 51: (False, 50), 52: (True, 52)}


def test_lines_linked_through_a_linked_one(spark):
    """Two lines that are like a third one but not like each other are one component, whichever of the three leads their only band."""
    rng = random.Random(12)
    texts = []
    for f in range(60):
        own = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)]
        one, two = list(own), list(own)
        one[20:30], two[150:160] = "0123456789", "9876543210"
        texts += [(3 * f + i, "".join(x)) for i, x in enumerate((one, own, two))]
    sigs = {r["doc_id"]: r["b0"] for r in line_dedup.signed(table(spark, texts), 1, 1).collect()}
    met = [f for f in range(60) if sigs[3 * f] == sigs[3 * f + 1] == sigs[3 * f + 2]]
    assert len(met) > 20
    got = line_dedup.kept_lines(table(spark, [t for t in texts if t[0] // 3 in met]), 1, 1).collect()
    assert all(r["keep_doc_id"] == r["doc_id"] // 3 * 3 for r in got)


def test_line_blocks(spark):
    rng = random.Random(3)
    words = [f"{rng.randrange(10**8):08d}" for _ in range(70)]
    lines = {i: "".join(words[i : i + 20]) for i in range(50)}
    texts = spark.createDataFrame(list(lines.items()), "code long, line string")
    rest = spark.createDataFrame([(i, 5) for i in range(50)], "code long, band long")
    like = {(i, j) for i in lines for j in range(i) if (lambda a, b: len(a & b) >= 0.8 * len(a | b))(line_set(lines[i])[1], line_set(lines[j])[1])}
    assert len(like) > 90
    for block, chars in ((7, 1 << 19), (256, 900), (256, 1 << 19)):
        got = [(r["a"], r["b"]) for r in line_dedup.among(rest, texts, block, chars).collect()]
        assert {(max(p), min(p)) for p in got} <= like and union(50, got) == union(50, like)
    # Members that are not open are compared with open ones alone.
    some = spark.createDataFrame([(i, 5, i % 4 == 0, i) for i in range(50)], "code long, band long, open boolean, root long")
    for block in (7, 256):
        got = [(r["a"], r["b"]) for r in line_dedup.among(some, texts, block).collect()]
        assert union(50, got) == union(50, [p for p in like if p[0] % 4 == 0 or p[1] % 4 == 0])


def test_min_hashes_of_pieces(monkeypatch):
    rng = random.Random(2)
    lines = ["", "short", "x" * 500, *("".join(rng.choice("abcdefg é中🙂") for _ in range(rng.choice([5, 8, 9, 60, 3000]))) for _ in range(80))]
    want = [[int((np.unique(line_dedup.shingle_hashes(line_dedup.filled(x))) * k).min()) for k in line_dedup._KEYS[:10]] for x in lines]
    for run in (1 << 15, 40, 300):
        monkeypatch.setattr(line_dedup, "RUN", run)
        assert line_dedup.min_hashes(lines, 10).T.tolist() == want
    same = defaultdict(set)
    for x in lines:
        f = line_dedup.filled(x)
        for i, h in enumerate(line_dedup.shingle_hashes(f).tolist()):
            same[h].add(f[i : i + 8])
    assert all(len(v) == 1 for v in same.values())


def test_line_recall(spark):
    """Pairs of lines just above the threshold, by themselves: nearly all are found, and no pair below it."""
    rng = random.Random(14)
    own = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)]
    texts, want = [], {}
    for f in range(1500):
        one = own(rng.randint(60, 300))
        other, k = list(one), rng.randint(1, 3 + len(one) // 60)
        for _ in range(k):
            other[rng.randrange(len(one))] = rng.choice("0123456789")
        a, b = (line_set("#" + "".join(x))[1] for x in (one, other))
        want[f] = len(a & b) / len(a | b)
        texts += [(2 * f, "#" + "".join(one)), (2 * f + 1, "#" + "".join(other))]
    found = {r["doc_id"] // 2 for r in line_dedup.kept_lines(table(spark, texts)).collect() if not r["kept"]}
    near = {f for f, j in want.items() if j >= 0.8}
    edge = {f for f in near if want[f] < 0.9}
    assert found <= near and len(near) > 300 and len(edge) > 80
    assert len(found & near) >= 0.98 * len(near) and len(found & edge) >= 0.95 * len(edge)


def test_sieve(spark):
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(5000)], "n long, key string")
    wanted = rows.filter("n % 10 = 3").select("key")
    got = {r["n"] for r in common.sieved(rows, wanted, "key").collect()}
    assert got >= set(range(3, 5000, 10)) and len(got) < 800
    assert common.sieved(rows, wanted, "key", 1).count() >= 500  # a full bitmap lets all rows through
    assert common.sieved(rows, wanted.limit(0), "key").count() == 0


def test_union_find(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(100)]
    rng.shuffle(chain)
    edges = chain + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 600 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = union(700, edges)
    ends = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {x: root[x] for x in ends}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_join(spark):
    left = spark.createDataFrame([(i, "hot") for i in range(3000)] + [(i, f"k{i}") for i in range(20)] + [(9, None)], "n long, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    got = common.join_hot(left, right, "k")
    assert got.count() == 3021 and got.filter("v = 1").count() == 3000 and got.filter("v = 2").count() == 1
    assert common.join_hot(left, right, "k", "inner").count() == 3001
    few = common.join_hot(left, right, "k", share=3)  # one hot key in three parts
    assert sorted(map(str, few.select("n", "k", "v").collect())) == sorted(map(str, left.join(right, "k", "left").select("n", "k", "v").collect()))


def test_hot_join_with_buckets(spark):
    rows = [(i, i % 300 if i % 3 else 7) for i in range(6000)] + [(-1, 900)]
    left = common.saved(spark.createDataFrame(rows, "x long, k long"), "left")
    right = common.bucketed(spark.createDataFrame([(k, f"t{k}") for k in range(310)], "k long, t string"), "k", 1000)
    got = sorted(tuple(r) for r in common.join_bucketed(left, right, "k").select("x", "k", "t").collect())
    assert got == sorted((x, k, f"t{k}") for x, k in rows if k < 310)
    common.discard(right)
    assert not spark.catalog.tableExists(right._name)


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, chosen_path.jaccard_links, compact_windows.repeated_passages, line_dedup.kept_lines])
def test_empty_tables(spark, operator):
    assert operator(table(spark, [])).count() == 0
    assert operator(table(spark, [(1, None), (2, "")])).filter("doc_id is null").count() == 0


def test_windows_go_before_bands_are_written(spark, corpus, monkeypatch):
    """The largest scratch table of op8 is gone when those made from its shared windows are written."""
    made, there = {}, {}

    def watched(df, name):
        if name == "banded":
            there.update({n: os.path.exists(t._scratch.removeprefix("file://")) for n, t in made.items() if n in ("windows", "again", "shared")})
        made[name] = common.saved(df, name)
        return made[name]

    monkeypatch.setattr(compact_windows, "saved", watched)
    compact_windows.repeated_passages(table(spark, corpus)).count()
    assert there == {"windows": False, "again": False, "shared": True}
