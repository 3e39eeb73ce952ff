"""Operators against slow, plain versions of the same contract."""

import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import common, embed_graph, media, packing, sharding, simhash, substring, token_store
from foliant.llm.tokens import ids_of, tokenizer_path

SF = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def plain_ids(name, text):
    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(spark):
    r = random.Random(3)
    odd = ["a  b", " lead", "trail ", "I'm  <|endoftext|> x", "İstanbul ÀÉ ß ﬁ", "tab\tnew\nline \n", "x y", "日本語 text", "don't we'll", "é", "", " ", "12 34.5 --", "A" * 3000, "😀 b"]
    odd += ["".join(r.choice("ab 'sé\n\t ß1!İ") for _ in range(60)) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library, fast = Tokenizer.from_file(tokenizer_path(name)), ids_of(tokenizer_path(name))
        for t in [*odd, *texts_of(spark).values()]:
            assert np.frombuffer(fast(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, (name, t[:80])


def test_words_of_letters_need_no_pattern():
    """The usual words, and what follows them: their ids are the library's, and the pattern that cuts words is left alone."""
    path = tokenizer_path("byte_bpe_50k.json")
    fast, library = ids_of.__wrapped__(path), Tokenizer.from_file(path)
    text = "a thoronble, thionbleq. Ünïcödè größe. wordsx1 don' xé, (end)"
    pieces, asked = fast.pieces, []
    fast.pieces = lambda word: asked.append(word) or pieces(word)
    assert np.frombuffer(fast(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked == ["a", " (end)"]


def test_token_files_give_back_every_document(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    path, folder = tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/shards"
    manifest = token_store.write_shards(docs, folder, path)
    got = {r.doc_id: r for r in token_store.read_shards(manifest, folder).collect()}
    start = 0
    for doc, text in sorted(texts_of(spark).items()):
        ids = [*np.frombuffer(ids_of(path)(text), "<u4").tolist(), 1]
        assert (got[doc].start, got[doc].n_tokens) == (start, len(ids)) and np.frombuffer(got[doc].ids, "<u4").tolist() == ids
        start += len(ids)
    some = sorted(got)[len(got) // 2]
    assert token_store.read_document(manifest, folder, some) == np.frombuffer(got[some].ids, "<u4").tolist()
    assert token_store.read_document(manifest, folder, -5) is None


def slow_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark):
    texts = texts_of(spark)
    prints = {i: slow_print(t) for i, t in texts.items()}
    ids = sorted(prints)
    groups = closure(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {i: (f"{prints[i]:016x}", groups[i]) for i in ids} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}


def test_simhash_links_at_each_distance(spark):
    """Chains of fingerprints three bits apart, and pairs four apart."""
    r = random.Random(1)
    prints = []
    for _ in range(60):
        p = r.getrandbits(64)
        for d in (3, 3, 4, 2, 1):
            prints.append(p)
            for b in r.sample(range(64), d):
                p ^= 1 << b
    prints = sorted(set(prints))
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fingerprint long, rep long")
    want = closure(range(len(prints)), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {x.rep: x.component for x in simhash.link_groups(rows).collect()} == want


def test_shards_have_the_least_capacity(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.choice((0, 3, 40, 500, 2000)) + str(i % 70)) for i in range(300)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    first, size = {}, {}
    for i, t in rows:
        first.setdefault(t, i)
        size[first[t]] = size.get(first[t], 0) + len(t) + 1
    sizes = [size[g] for g in sorted(size)]

    def needed(capacity):
        n, room = 0, 0
        for s in sizes:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= 8)
    load, slots = {}, {}
    for x in got:
        load[x.shard] = load.get(x.shard, 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
        assert x.group_id == first[dict(rows)[x.doc_id]] and x.text_crc32 == zlib.crc32(dict(rows)[x.doc_id].encode())
    assert max(load.values()) == least
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing_is_whole_and_full(spark):
    path, texts = tokenizer_path("byte_bpe_50k.json"), texts_of(spark)
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), path).collect()
    by_doc, by_seq = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, text in texts.items():
        pieces = sorted(by_doc[doc], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in pieces) == ids_of(path)(text) + b"\x01\0\0\0"
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
    for pieces in by_seq.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist() and sum(p.length for p in pieces) <= 2048
    assert sum(p.length for p in got) >= 0.97 * 2048 * (len(by_seq) - 8)


def test_media_round_trip(spark):
    rows = media.media_features(media.store_media(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    texts = texts_of(spark)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert bytes(r.payload) == media.padded(raw) and r.n_bytes == len(raw) and len(r.payload) % 576 == 0
        assert list(r.fingerprint) == sorted(set(r.fingerprint))


def slow_peaks(payload):
    """Pairs of peaks by a plain Fourier sum."""
    n, frames = 576, []
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    waves = np.exp(-2j * np.pi * np.outer(np.arange(1, n // 2 + 1), np.arange(n)) / n)
    for at in range(0, len(payload) - n + 1, 288):
        power = np.abs(waves @ np.array([(b - 128) * w for b, w in zip(payload[at : at + n], window)]))
        tops = sorted((-power[k], k + 1) for k in range(1, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1])
        frames.append([b for _, b in tops[:3]])
    peaks = [(f, b) for f, bins in enumerate(frames) for b in bins]
    return sorted({f << 32 | b << 16 | c << 4 | (g - f) for i, (f, b) in enumerate(peaks) for g, c in peaks[i + 1 : i + 9] if g - f <= 2})


def test_media_against_plain_sums(spark):
    """Payload, stored form and peak pairs of texts without ties of strength, worked out plainly."""
    import hashlib
    import io
    import wave

    texts = {i: t for i, t in texts_of(spark).items() if t and len(t) < 4000 and len(set(t)) > 12}
    some = dict(sorted(texts.items())[:25])
    got = {r.doc_id: r for r in media.digests(media.media_features(media.store_media(spark.createDataFrame(list(some.items()), "doc_id long, text string")))).collect()}
    for doc, text in some.items():
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert (r.payload_sha256, r.media_bytes, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert list(r.fingerprint) == slow_peaks(payload)


def test_embedding_links_and_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.label, np.array(r.embedding, np.float64)) for r in vectors.collect()]
    unit = {i: v / np.linalg.norm(v) for i, _, v in rows}
    label = {i: y for i, y, _ in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    degree = {i: 0 for i in unit}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    result = embed_graph.near_duplicates(vectors)
    got = {r.vec_id: r for r in result.collect()}
    assert all(got[i].n_links <= degree[i] for i in unit)
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(links)
    want = closure(sorted(unit), links)
    assert sum(got[i].component_id == want[i] for i in unit) >= 0.97 * len(unit)
    assert embed_graph.audit_recall(vectors, result) >= 0.9


def test_repeated_vector_ids_are_vectors_of_their_own(spark):
    """Rows that share a vec_id, with equal and with other vectors, against all pairs."""
    r = random.Random(4)
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.01], 1)]
    for _ in range(60):
        a = r.choice([0.0, 0.3, 0.6, 1.2, 2.0])
        rows.append((r.randrange(10, 30), [float(np.float32(np.cos(a))), float(np.float32(np.sin(a)))], r.choice([1, 2])))
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93]
    groups = closure(range(len(rows)), [(i, j) for i, j in links if i < j])
    least = {}
    for i, g in groups.items():
        least[g] = min(least.get(g, 1 << 40), rows[i][0])
    want = sorted((rows[i][0], sum(a == i for a, _ in links), least[groups[i]], rows[i][0] == least[groups[i]]) for i in range(len(rows)))
    got = embed_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(tuple(x) for x in got) == want


def test_components_of_stars_and_paths(spark):
    star = spark.range(1, 20_001).selectExpr("id as a", "0L as b")
    path = spark.range(1_000_000, 1_005_000).selectExpr("id as a", "id + 1 as b")
    got = common.components(star.union(path)).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {0: 20_001, 1_000_000: 5001}


def test_graph_search_finds_a_large_group(spark):
    """More vectors than a shard holds, half of them near one another."""
    r = np.random.default_rng(0)
    centre = r.normal(size=16)
    v = np.concatenate((centre + 0.05 * r.normal(size=(1500, 16)), r.normal(size=(1500, 16)))).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = embed_graph.near_duplicates(rows)
    assert got.where("vec_id < 1500 and component_id <> 0").count() == 0
    assert embed_graph.audit_recall(rows, got) >= 0.9


def test_graph_search_finds_every_large_group_of_a_label(spark):
    """Groups that hold more than the nearest vectors that pruning looks at: the graph of their shard falls into parts."""
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(size=16) + 0.03 * r.normal(size=(160, 16)) for _ in range(3)]).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = embed_graph.near_duplicates(rows)
    assert {(r.vec_id // 160, r.component_id) for r in got.collect()} == {(0, 0), (1, 160), (2, 320)}
    assert embed_graph.audit_recall(rows, got, every=1) >= 0.99


WORDS = [f"w{i}" for i in range(4000)]


def test_fuzzy_passages_are_found_and_cut(spark):
    r = random.Random(9)
    make = lambda n: [r.choice(WORDS) for _ in range(n)]
    passage = make(80)
    fuzzy = [w if r.random() > 0.06 else "other" for w in passage]
    short = make(30)
    rows = [(1, make(100) + passage + make(40)), (2, make(70) + fuzzy + make(90)), (3, make(20) + short + make(200)), (4, make(33) + short + make(90)), (5, make(300)), (6, passage)]
    rows.append((7, rows[4][1]))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = substring.find_passages(docs).collect()
    # 6 is tied to the first that has its seeds and to the one before it.
    assert {(f.doc_id, f.source_id) for f in found} == {(2, 1), (6, 1), (6, 2), (7, 5)}
    text = {i: " ".join(w) for i, w in rows}
    for f in found:
        assert f.words >= 50 and f.similarity >= 0.8
        own, other = text[f.doc_id][f.start : f.start + f.length].split(), text[f.source_id][f.source_start : f.source_start + f.source_length].split()
        assert len(set(own) & set(other)) >= 0.8 * len(set(own)) and len(own) >= 70
    left = {x.doc_id: x.text for x in substring.remove_passages(docs, substring.find_passages(docs)).collect()}
    assert left[1] == text[1] and left[5] == text[5] and left[7] == "" and len(left[2].split()) in range(155, 172)


def test_chain_scores_against_quadratic_chaining():
    """The Fenwick tree's best chain to each anchor is the best that trying every predecessor finds; chains share no anchor and leave none."""
    r = random.Random(2)
    for _ in range(300):
        size, n = r.choice((100, 400)), r.choice((12, 30, 60))
        anchors = sorted([r.randrange(size), r.randrange(size), r.randrange(4, 40), 1] for _ in range(n))
        want = []
        for i, (a, b, length, _) in enumerate(anchors):
            want.append(float(length))
            for j in range(i):
                x, y = anchors[j][0] + max(1, anchors[j][2] - substring.K + 1), anchors[j][1] + max(1, anchors[j][2] - substring.K + 1)
                if x <= a and y <= b:
                    want[i] = max(want[i], length + want[j] - substring.GAP_COST * (a - x + b - y))
        assert np.allclose(substring.chain_scores(anchors)[0], want)
        assert sorted(sum(substring.chain_members(anchors), [])) == anchors


def test_every_run_of_50_words_is_covered(spark):
    """Against all runs of 50 words of all documents (but repeats of a document within 50 words): recall 1."""
    texts = sorted((i, t or "") for i, t in texts_of(spark).items())
    found = substring.find_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    spans, first = {}, {}
    for f in found:
        spans.setdefault(f.doc_id, []).append((f.start, f.start + f.length))
    total = 0
    for doc, text in texts:
        words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        runs = [tuple(w[0] for w in words[i : i + 50]) for i in range(len(words) - 49)]
        last = {}
        for i, run in enumerate(runs):
            if first.get(run, doc) != doc and i - last.get(run, -50) >= 50:
                total += 1
                assert any(a <= words[i][1] and words[i + 49][2] <= b for a, b in spans.get(doc, []))
            last[run] = i
        for run in runs:
            first.setdefault(run, doc)
    assert total > 1000


def test_partial_holders_hide_no_copies(spark):
    """Documents that hold parts of a passage, before those that hold all of it and between them."""
    r = random.Random(8)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p = make(120)
    parts = [p[:42], p[42:84], p[80:]]
    rows = [(i, make(30) + parts[i] + make(30)) for i in range(3)] + [(i, make(40) + p + make(40)) for i in (4, 6, 12)]
    rows += [(7 + i, make(30) + p[12 * i : 12 * i + 49] + make(30)) for i in range(5)]
    found = substring.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(f.doc_id, f.words) for f in found} >= {(6, 120), (12, 120)} and {f.doc_id for f in found} == {6, 12}


def test_ties_across_tasks(spark):
    """A key of most rows, and its documents, in the order of the rows whatever the tasks that they fall to."""
    r = random.Random(3)
    rows = sorted({(r.choice((7, 7, 7, 1, 2, 9)), r.randrange(40), r.randrange(30)) for _ in range(900)})
    got = {(x.key, x.doc_id, x.word): (x.f_doc, x.f_word, x.p_doc, x.p_word) for x in substring.tie(spark.createDataFrame(rows, "key long, doc_id long, word int").repartition(7), "ties").collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        own = [x[1:] for x in rows if x[0] == key]
        for doc, word in own:
            before = [x for x in own if x[0] < doc]
            if before:
                want[key, doc, word] = (*before[0], *before[-1])
    assert got == want


def test_least_of_windows_against_each_window(monkeypatch):
    """Repeats too; and where there are none, windows are not looked at one by one."""
    r = np.random.default_rng(5)
    for size, most in [(35, 10**9), (36, 10**9), (400, 10**9), (400, 30), (90, 2)]:
        code = r.integers(0, most, size, dtype=np.uint64)
        want = sorted({i + int(code[i : i + 35].argmin()) for i in range(size - 34)})
        assert substring.least_of_windows(code, 35).tolist() == want
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", None)
    assert len(substring.seeds_of(" ".join(f"w{i}" for i in range(300)))[0])


def test_sources_of_one_short_seed_are_not_weighed(monkeypatch):
    """A document's seeds of hundreds of sources: only those that could hold enough words are looked at."""
    import pyarrow as pa

    weighed, held = [], substring._held
    monkeypatch.setattr(substring, "_held", lambda word, span: weighed.append(len(word)) or held(word, span))
    hits = [{"word": 10 * i, "span": 4, "f_doc": i, "f_word": 3, "p_doc": None, "p_word": None} for i in range(300)]
    hits += [{"word": 4000 + 5 * i, "span": 4, "f_doc": 900, "f_word": 5 * i, "p_doc": None, "p_word": None} for i in range(4)]
    kind = pa.list_(pa.struct([("word", pa.int32()), ("span", pa.int32()), ("f_doc", pa.int64()), ("f_word", pa.int32()), ("p_doc", pa.int64()), ("p_word", pa.int32())]))
    chains = list(substring._chain(iter([pa.RecordBatch.from_arrays([pa.array([999]), pa.array([hits], kind)], ["doc_id", "hits"])])))
    assert [c.column(1).to_pylist() for c in chains] == [[900]] and set(weighed) == {4}


def test_repeated_words_are_one_chain(spark):
    rows = [(1, "the " * 400 + "end"), (2, "The " * 300), (3, "so " + "the " * 500)]
    found = substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(f.doc_id, f.source_id): f.words for f in found}.keys() == {(2, 1), (3, 1), (3, 2)} and len(found) < 8


def test_every_stretch_of_a_chain_is_found(spark):
    """Two passages of 60 words with 20 own words between them: one chain, and too far apart for one stretch."""
    r = random.Random(4)
    make = lambda n, k: [f"{k}{r.randrange(10**6)}" for _ in range(n)]
    p, q = make(60, "p"), make(60, "q")
    rows = [(i, " ".join(make(30, "x") + p + make(20, "y") + q + make(30, "z"))) for i in (1, 2)]
    found = substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)[2]
    cut = sorted(text[f.start : f.start + f.length].split() for f in found)
    assert cut == sorted([p, q]) and all(f.similarity == 1.0 and f.words == 60 for f in found)


def test_alignment_keeps_what_the_chain_found(spark):
    """Long words; and a frequent run of three words before a passage that the other text has within it."""
    r = random.Random(6)
    make = lambda n, k, size=1: [f"{k}{r.randrange(10**6)}".ljust(size, "u") for _ in range(n)]
    p, q = make(60, "p", 40), make(60, "q")
    q[30:33] = ["in", "any", "case"]
    rows = [(1, make(40, "x") + p + make(40, "y")), (2, make(40, "z") + p + make(40, "a")), (3, make(40, "b") + q + make(40, "c"))]
    rows.append((4, make(25, "d") + ["in", "any", "case"] + make(5, "e") + q + make(40, "f")))
    text = {i: " ".join(w) for i, w in rows}
    found = substring.find_passages(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()
    assert {(f.doc_id, f.source_id): text[f.doc_id][f.start : f.start + f.length].split() for f in found} == {(2, 1): p, (4, 3): q} and len(found) == 2


def test_every_place_of_a_passage_is_found(spark):
    r = random.Random(7)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p, own = make(60), make(70)
    rows = [(1, " ".join(p)), (2, " ".join([*p, *own, *p, *own[:40], *p]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring.find_passages(docs).where("doc_id = 2 and source_id = 1 and words = 60").count() == 3
    left = {x.doc_id: x.text.split() for x in substring.remove_passages(docs, substring.find_passages(docs)).collect()}
    assert left[2] == own + own[:40]


def test_passages_whose_parts_occur_first_elsewhere(spark):
    """Three lines that three documents have singly; and a variant with half of a passage before two that have it all."""
    for seed in range(4):
        r = random.Random(seed)
        make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
        lines, q = [make(20) for _ in range(3)], make(70)
        rows = [(i, make(40) + lines[i] + make(40)) for i in range(3)] + [(i, make(40) + sum(lines, []) + make(40)) for i in (3, 4)]
        rows += [(5, make(40) + q[:35] + make(40)), (6, make(40) + q + make(40)), (7, make(40) + q + make(40))]
        text = {i: " ".join(w) for i, w in rows}
        found = substring.find_passages(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()
        assert {(f.doc_id, f.source_id): text[f.doc_id][f.start : f.start + f.length].split() for f in found} == {(4, 3): sum(lines, []), (7, 6): q}


def _scattered():
    """Eight lines of a passage that eight documents have singly, before and after the document that has them all; a later one has the passage with every eighth word changed."""
    r = random.Random(11)
    make = lambda n: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]
    lines = [make(8) for _ in range(8)]
    texts = {100: make(60) + sum(lines, []) + make(60), 300: make(60) + sum(([*line[:7], "other"] for line in lines), []) + make(60)}
    for i, line in enumerate(lines):
        texts[i], texts[200 + i] = make(60) + line[:7] + make(60), make(60) + line[:7] + make(60)
    return {i: " ".join(w) for i, w in texts.items()}


def test_edited_passages_whose_seeds_are_scattered(spark):
    found = substring.find_passages(spark.createDataFrame(list(_scattered().items()), "doc_id long, text string")).where("doc_id = 300").collect()
    assert [(x.source_id, 55 <= x.words <= 64, x.similarity >= 0.8) for x in found] == [(100, True, True)]


def test_places_of_one_seed_in_squares(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 2)
    found = substring.find_passages(spark.createDataFrame(list(_scattered().items()), "doc_id long, text string")).where("doc_id = 300").collect()
    assert [x.source_id for x in found] == [100]


def test_ties_count_places_and_not_documents(spark):
    """A document that has a seed at two places is tied to at one of them only."""
    rows = spark.createDataFrame([(7, 1, 5), (7, 1, 400), (7, 2, 9), (8, 1, 70), (8, 3, 1), (8, 4, 2)], "key long, doc_id long, word int").repartition(3)
    got = {(x.key, x.doc_id): x.left_out for x in substring.tie(rows, "ties").selectExpr("key", "doc_id", f"{substring.UNTIED} AS left_out").collect()}
    assert got == {(7, 2): True, (8, 3): False, (8, 4): False}


def test_what_may_align_loses_no_pair():
    """Words with at most LACK of MIN_WORDS changed about a seed always pass; lengths are those of plain subsequences."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    for span in (substring.K, substring.LONG):
        rest, own, other = substring.MIN_WORDS - span, [], []
        for _ in range(200):
            left = int(r.integers(0, rest + 1))
            word = r.integers(0, 256, (2, substring.REACH))
            lost = [np.zeros(substring.REACH, bool) for _ in (0, 1)]
            for i in r.permutation(rest)[: substring.LACK]:
                lost[int(i >= left)][i if i < left else i - left] = True
            changed = [np.where(x, (w + 1) % 256, w) for w, x in zip(word, lost)]
            for w, side, n in zip(changed, (0, 1), (left, rest - left)):
                w[n:] = r.integers(0, 256, substring.REACH - n)
            own.append([w.astype(np.uint8).tobytes() for w in changed])
            other.append([w.astype(np.uint8).tobytes() for w in word])
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("word", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]))
        lists = [pa.array([[(doc, 7, *x)] for x in side], kind) for doc, side in ((1, other), (2, own))]
        got = list(substring._compare(iter([pa.RecordBatch.from_arrays([pa.array([int(span == substring.LONG)] * 200), *lists], ["key", "earlier", "afterwards"])])))
        assert sum(x.num_rows for x in got) == 200
        swapped = list(substring._compare(iter([pa.RecordBatch.from_arrays([pa.array([int(span == substring.LONG)] * 200), lists[1], lists[0]], ["key", "earlier", "afterwards"])])))
        assert sum(x.num_rows for x in swapped) == 0  # only earlier documents count
    a, b = r.integers(0, 6, (50, 30)), r.integers(0, 6, (50, 64))
    lengths = substring._common_lengths(a, b)
    assert all(lengths[i, n] == len(substring._common(a[i, :n].tolist(), b[i].tolist())[0]) for i in range(50) for n in (1, 8, 30))


def test_a_family_of_edited_passages_makes_one_candidate_a_place(spark, monkeypatch):
    """Of n documents that have an edited passage each place is tied to its best match only, not to all n; each document's passage is found all the same."""
    r = random.Random(21)
    make = lambda n: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]
    base, sizes, untied = make(70), [], substring._untied
    edited = lambda at: [make(1)[0] if i % 10 == at else w for i, w in enumerate(base)]
    texts = [(i, " ".join(make(60) + edited(r.randrange(10)) + make(60))) for i in range(40)]
    monkeypatch.setattr(substring, "_untied", lambda *a: sizes.append((out := untied(*a)).count()) or out)
    seeds = {(k, i) for i, t in texts for k in substring.seeds_of(t)[0].tolist()}
    found = substring.find_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {f.doc_id for f in found} == set(range(1, 40))
    assert sum(sizes) <= len(seeds)


def test_places_are_tied_to_their_best_match():
    """_candidates: of each place one pair, that with most in common; or all pairs. Runs of 49 words in common are none."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    other = lambda n: r.integers(1, 1 << 16, n).astype(np.uint16)
    near = other(2 * substring.REACH)
    short, edited = near.copy(), near.copy()
    short[24 : substring.REACH], short[substring.REACH + 21 :] = other(substring.REACH - 24), other(substring.REACH - 21)  # 24 + 4 + 21 words
    edited[[3, 70]] = other(2)
    def of(best: bool, *rows: tuple[int, np.ndarray]) -> list[tuple[int, int]]:
        n = len(rows)
        later = pa.array([*[0] * (n - 1), 1], pa.int32())
        arrays = [pa.array([8] * n), pa.array([0] * n), pa.array([0] * n), later, pa.array([i for i, _ in rows]), pa.array([200] * n, pa.int32()), pa.array([500] * n, pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())]
        batch = pa.RecordBatch.from_arrays(arrays, ["key", "_row", "_column", "later", "doc_id", "word", "words", "about"])
        return sorted((x["doc_id"], x["f_doc"]) for b in substring._candidates(iter([batch]), best) for x in b.to_pylist())

    rows = [(1, short), (2, edited), (3, near), (4, near)]
    assert of(True, *rows) == [(4, 3)] and of(False, *rows) == [(4, 2), (4, 3)]
    assert of(True, rows[0], rows[3]) == of(True, rows[3]) == []


def test_seeds_of_many_texts_are_those_of_each():
    r = random.Random(8)
    texts = ["", " \n", "a b"] + [" ".join(r.choice(["ou", "é", f"w{r.randrange(40)}"]) for _ in range(r.choice([3, 49, 50, 51, 300]))) for _ in range(30)]
    code, text, word = substring.seeds_of_all(texts)
    for i, t in enumerate(texts):
        assert sorted(zip(code[text == i].tolist(), word[text == i].tolist())) == sorted(zip(*[x.tolist() for x in substring.seeds_of(t)]))
    assert set(text.tolist()) == {i for i, t in enumerate(texts) if len(t.split()) >= substring.MIN_WORDS}
