import random
import re
import tracemalloc

import pytest
from evidloom.llm import catalog, jaccard_join
from evidloom.llm import shingles as shingles_of
from evidloom.llm.common import table
from evidloom.llm.components import components
from oracle import check


def shingles(text, size=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, percent=80):
    """n_shingles and component of each row, by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    having = {}
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in having[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_contract(spark, sf):
    d = f"/root/testdata/sf{sf}"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    assert got(catalog.op5_jaccard_join(spark, d)) == brute(docs)


def chains(rng, n):
    """Texts that drift away from their first, so that links form chains; a group of near copies; a shared passage."""
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop")
    docs, common = [], [word() for _ in range(60)]
    for c in range(4):
        w = [word() for _ in range(rng.choice([40, 80]))]
        for _ in range(n):
            w = list(w)
            w[rng.randrange(len(w))] = word()
            docs.append(w)
    base = [word() for _ in range(100)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(100)] = word()
        docs.append(w)
    docs += [[*common, *(word() for _ in range(rng.randrange(3, 25)))] for _ in range(n)]
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("rounds", [(2, 3), ()])
def test_chains(spark, rounds, monkeypatch):
    docs = chains(random.Random(3), 40)
    monkeypatch.setattr(jaccard_join.links, "__defaults__", (rounds,))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(jaccard_join.near_duplicates(df, block_bytes=2000)) == brute(docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two three"), (7, "one two three "), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (8, "x y z u v w " * 4000), (8, "x y z u v w " * 4000), (9, "q r s t u v w x y z"), (9, "completely other words are in this text"), (10, "q r s t u v w x y z")]
    df = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, sig int, row int")
    assert got(jaccard_join.near_duplicates(df)) == brute(docs)
    kept = jaccard_join.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, None, 8, 9, 9]))
    assert jaccard_join.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    rng, n = random.Random(5), 200
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, n), rng.randrange(100, n)) for _ in range(60)] + [(70, 70)]
    parent = list(range(n))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want


def test_similar_gives_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 7)
    docs = chains(random.Random(8), 25) + [(900, None), (901, " "), (902, "a b c d e f"), (903, "A b c d e f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    links, rows = jaccard_join.similar(df, block_bytes=2000)
    of = {r.doc_id: r["class"] for r in rows.collect()}
    assert of[900] is None and of[901] is None and of[902] == of[903]
    got = {frozenset((r.class_u, r.class_v)) for r in links.collect()}
    sets = {of[d]: shingles(t) for d, t in docs if shingles(t)}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got == want


def test_long_lists_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 5)
    monkeypatch.setattr(jaccard_join.links, "__defaults__", ((),))
    docs = chains(random.Random(4), 25)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(jaccard_join.near_duplicates(df, block_bytes=2000)) == brute(docs)


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    check(catalog.op5_jaccard_join(spark, d), d, jaccard_join.ORACLE)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_words_cut_by_pieces_keep_their_hash(monkeypatch, piece):
    """Words are the same whatever the pieces are; equal words have equal hashes, different ones others."""
    rng = random.Random(piece)
    texts = ["", " ", "a", "a ", " a", "ab", "abcdefgh", "x" * 50] + ["".join(rng.choices("ab \n\té", k=rng.randrange(60))) for _ in range(200)]
    want = [[(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t.encode())] for t in texts]
    whole = [shingles_of.word_hashes(t.encode())[1].tolist() for t in texts]
    monkeypatch.setattr(shingles_of, "CHUNK", piece)
    hash_of = {}
    for t, words, before in zip(texts, want, whole, strict=True):
        starts, hashes = shingles_of.word_hashes(t.encode())
        assert hashes.tolist() == before
        assert starts.tolist() == [a for a, _ in words]
        for (_, w), h in zip(words, hashes.tolist(), strict=True):
            assert hash_of.setdefault(w, h) == h
    assert len(set(hash_of.values())) == len(hash_of)


def test_one_long_word_takes_bounded_room():
    """Beside the text and its copy, room for arrays of a piece, not of the word."""
    text = b"w" * (20 << 20) + b" " + b"w" * (20 << 20)
    tracemalloc.start()
    starts, hashes = shingles_of.word_hashes(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert starts.tolist() == [0, (20 << 20) + 1] and hashes[0] == hashes[1]
    assert peak < 128 << 20


def test_texts_are_hashed_once_for_the_rows_that_stay(spark, monkeypatch):
    """Rows with the head's id and words but another text, copies, blank and null ones; texts go through Python signatures once."""
    calls, before = [], jaccard_join.signatures
    monkeypatch.setattr(jaccard_join, "signatures", lambda *a: calls.append(a) or before(*a))
    rows = [(1, "a b c d e f", "x"), (1, "a  b c d e f", "y"), (1, "a b c d e f", "x"), (2, "A b c d e f", "z"), (3, " ", "p"), (3, " ", "q"), (None, None, "r"), (None, "", "s"), (4, "g h", "t"), (None, "g h", "u"), (None, "k", "v"), (None, "k", "w")]
    kept = jaccard_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.more) for r in kept if r.more in "pqrst") == [(0, "r"), (0, "s"), (3, "p"), (3, "q"), (4, "t")]
    rest = [r.more for r in kept if r.more not in "pqrst"]
    assert len(rest) == 2 and sum(m in "xy" for m in rest) == 1 and sum(m in "vw" for m in rest) == 1
    assert len(calls) == 1
