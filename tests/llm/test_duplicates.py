import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from taskloom.llm import near_duplicates
from taskloom.llm.graph import components
from taskloom.llm.near_duplicates import _meet_here, band_keys, drop_near_duplicates, link_documents, minima, packed_bits, shingle_sets
from taskloom.llm.phrase_dedup import PassageAutomaton, remove_repeated_passages
from taskloom.llm.words import text_chunks, window_hashes

from .conftest import EDGES, documents_frame


def shingles(text, size):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute_components(rows, size, percent):
    """Smallest id per row's component; rows are (id, text) with ids."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and 100 * both >= percent * union:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(rows))]


def family(seed, groups, copies, length):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = random.choices(vocabulary, k=length)
        for _ in range(copies):
            text = list(base)
            for _ in range(random.randint(0, length // 20)):
                text[random.randrange(length)] = random.choice(vocabulary)
            rows.append(" ".join(text) if random.random() < 0.8 else " ".join(text).upper())
    random.shuffle(rows)
    return list(enumerate(rows, start=5))


def test_components_equal_brute_force(spark):
    rows = family(1, 25, 8, 60) + [(1000 + i, f"lonely text number {i}") for i in range(5)]
    got = {r.doc_id: r for r in link_documents(documents_frame(spark, rows), 4, 80).collect()}
    for (d, text), least in zip(rows, brute_components(rows, 4, 80)):
        assert got[d].component_id == least and got[d].kept == (d == least)
        assert got[d].n_shingles == len(shingles(text, 4))


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"c{i}" for i in range(100)]
    rows = [(50 - k, " ".join(words[k * 5 : k * 5 + 60])) for k in range(8)]
    got = {r.doc_id: r.component_id for r in link_documents(documents_frame(spark, rows), 4, 80).collect()}
    assert [got[d] for d, _ in rows] == brute_components(rows, 4, 80)


def test_full_sets_of_a_pair_meet_in_one_bucket(spark):
    random.seed(6)
    held = {n: random.sample(range(-20, 20), random.randint(1, 12)) for n in range(12)}
    rows = spark.createDataFrame([(n, b, bs) for n, bs in held.items() for b in bs], "node long, bucket long, buckets array<long>")
    left, right = ([rows[c].alias(f"{side}{c}") for c in rows.columns] for side in ("m_", "l_"))
    pairs = rows.select(*left).join(rows.select(*right), (F.col("m_bucket") == F.col("l_bucket")) & (F.col("m_node") < F.col("l_node")))
    shared = {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b])}
    assert pairs.count() > len(shared)
    got = pairs.filter(_meet_here("m_", "l_")).select("m_node", "l_node").collect()
    assert sorted(map(tuple, got)) == sorted(shared)


def test_band_keys_of_many_sets_at_once():
    random.seed(7)
    texts = [" ".join(random.choices("abcdefgh", k=random.randint(1, 50))).encode() for _ in range(20)]
    least = np.stack([minima(s) for s in shingle_sets([*texts, b""], 2)])
    keys, bits = band_keys(least), packed_bits(least)
    assert keys.shape == (21, 32) and bits.shape == (21, 8)
    for m, k, b in zip(least, keys, bits):
        assert [int(window_hashes(np.append(m[4 * i : 4 * i + 4], i).astype(np.uint64), 5)[0]) for i in range(32)] == k.tolist()
        assert packed_bits(m).tolist() == b.tolist()


def test_estimate_is_corrected_for_chance():
    random.seed(2)
    for share in (0.0, 0.5, 0.8, 1.0):
        common = [f"s{i}" for i in range(int(1000 * share))]
        texts = [" ".join(common + [f"{side}{i}" for i in range(1000 - len(common))]) for side in "ab"]
        bits = [packed_bits(minima(s)) for s in shingle_sets([t.encode() for t in texts], 1)]
        equal = sum(((int(a ^ b) >> k) & 15) == 0 for a, b in zip(*bits) for k in range(0, 64, 4))
        similarity = share / (2 - share)
        assert abs((equal / 128 - 1 / 16) / (15 / 16) - similarity) < 0.15


def test_edge_rows(spark, edges, empty):
    rows = link_documents(edges, 5, 80).collect()
    assert len(rows) == len(EDGES)
    by = Counter((r.doc_id, r.component_id, r.kept, r.n_shingles > 0) for r in rows)
    assert by[(7, 6, False, True)] == 2 and by[(6, 6, True, True)] == 1
    assert by[(None, None, True, True)] == 1 and by[(None, None, True, False)] == 1
    assert all(by[(d, d, True, False)] == 1 for d in (1, 2, 3))
    assert by[(8, 8, True, True)] == 1 and by[(10, 10, True, True)] == 2
    assert link_documents(empty, 5, 80).collect() == []


def test_one_row_of_a_group_stays(spark, edges):
    kept = drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, None, None, 8, 9, 10, 10])


def test_graph_components(spark):
    random.seed(4)
    nodes = [random.getrandbits(60) for _ in range(300)]
    links = [(nodes[i], nodes[i + 1]) for i in range(99)] + [(nodes[100], n) for n in nodes[101:200]]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 200
    assert len({got[n] for n in nodes[:100]}) == 1 and len({got[n] for n in nodes[100:200]}) == 1
    assert got[nodes[0]] != got[nodes[100]]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_removal(rows, window=13):
    first = {}
    for d, text in rows:
        words = (text or "").encode().split()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, text in rows:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), dtype=bool)
        for p in range(len(words) - window + 1):
            if d is not None and first[tuple(words[p : p + window])] < d:
                gone[p : p + window] = True
        out.append((str(d), len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out)


def collected(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in frame.collect())


def test_removal_equals_brute_force(spark):
    random.seed(6)
    passages = [" ".join(random.choices("abcdefgh", k=random.randint(10, 40))) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(random.randint(1, 6)):
            parts.append(random.choice(passages) if random.random() < 0.5 else " ".join(random.choices([f"v{i}" for i in range(40)], k=9)))
        rows.append((random.randrange(80) - 20, "\n".join(parts)))
    rows += [(500, "na " * 400), (501, "na " * 30 + "x " + "na " * 12), (502, "na " * 13)]
    assert collected(remove_repeated_passages(documents_frame(spark, rows))) == brute_removal(rows)


def test_removal_on_edges(spark, edges, empty):
    assert collected(remove_repeated_passages(edges)) == brute_removal(EDGES)
    assert remove_repeated_passages(empty).collect() == []


def test_automaton_needs_the_whole_window():
    words = [f"p{i}".encode() for i in range(30)]
    automaton = PassageAutomaton([(3, b" ".join(words))])
    assert automaton.covered(9, words[5:17]).sum() == 0
    assert automaton.covered(9, [b"x"] + words[5:18] + [b"y"]).tolist() == [False] + [True] * 13 + [False]
    assert automaton.covered(3, words).sum() == 0


def test_large_ids_beside_a_null_id(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    ids = [2**60 + 1, 2**60 + 2, -(2**62), None]
    rows = documents_frame(spark, [(i, passage) for i in ids]).coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_passages(rows).collect()}
    assert got == {
        2**60 + 1: (20, 20, ""), 2**60 + 2: (20, 20, ""), -(2**62): (20, 0, passage), None: (20, 0, passage)
    }
    got = {r.doc_id: r.n_removed for r in remove_repeated_passages(rows.filter("doc_id > 0 OR doc_id IS NULL")).collect()}
    assert got == {2**60 + 1: 0, 2**60 + 2: 20, None: 0}


def test_full_sets_only_where_a_pair_is_compared(spark, monkeypatch):
    written = {}

    def spy(df, name="stage"):
        written[name] = near_duplicates_materialize(df, name)
        return written[name]

    near_duplicates_materialize = near_duplicates.materialize
    monkeypatch.setattr(near_duplicates, "materialize", spy)
    words = [f"w{i}" for i in range(400)]
    other = words[:170] + [f"v{i}" for i in range(60)] + words[230:]
    got = link_documents(documents_frame(spark, [(1, " ".join(words)), (2, " ".join(other))]), 4, 80).collect()
    assert {r.component_id for r in got} == {1, 2}
    # Alike enough to be compared, and together in several buckets.
    assert written["partners"].count() > 2
    assert written["likely"].count() == 2


def test_only_the_texts_of_a_chunk_are_copied():
    texts = [None, "", "x" * 5000, *["y" * 1000] * 4000, "z", None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for limit in (1, 1500, 65_536):
        chunks = list(text_chunks([batch, batch.slice(0, 0), batch.slice(3, 9)], limit=limit))
        assert [t for _, some in chunks for t in some] == [(t or "").encode() for t in texts + texts[3:12]]
        assert all(len(rows) == len(some) for rows, some in chunks)
        assert all(len(some) == 1 or sum(map(len, some)) <= limit for _, some in chunks)
    tracemalloc.start()
    for _ in text_chunks([batch], limit=65_536):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000
