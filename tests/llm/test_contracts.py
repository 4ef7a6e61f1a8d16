"""Each operator against a brute-force version on small tables with odd rows, and on empty tables."""

import base64
import glob
import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlake.llm import bpe, chat, fingerprints, mixing, near_dedup, neighbours, quality, suffix_dedup, token_store, toxicity
from tests.llm.conftest import words


def order(r):
    return (r[0] is not None, r[0] or 0)


def test_token_store_round_trip(make_docs, odd_rows):
    store = token_store.token_store(make_docs(odd_rows))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = {t: tokenizer.encode(t or "", add_special_tokens=False).ids for t in {r[1] for r in odd_rows}}
    digests = sorted(token_store.read_digests(store).collect(), key=lambda r: r.start)
    documents = {r.start: r for r in token_store.read_documents(store).collect()}
    assert [r.doc_id for r in digests] == [r[0] for r in sorted(odd_rows, key=order)]
    at, texts = 0, Counter((r[0], tuple(ids_of[r[1]])) for r in odd_rows)
    for r in digests:
        assert r.start == at
        ids = documents[at].ids
        texts[(r.doc_id, tuple(ids))] -= 1
        stream = np.array([*ids, 0], dtype="<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(stream), zlib.crc32(stream.tobytes()))
        at += len(stream)
    assert not any(texts.values())


def test_library_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, letters = np.random.default_rng(3), list("aaab  \n\t \x1c\x85'sd12½Ⅷé漢🙂_-.")
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(3000)] + ["a" * 2000, " " * 99, "don't 've'll", "one two\nThree\nfour."]
    got = token_store.library_encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_library_encoder_recognises_added_tokens():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "one <|endoftext| two", "<|ENDOFTEXT|>", "plain text"]
    got = token_store.library_encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 50_000, 5000).astype("<u4")
    plain = {body[a:b].tobytes() for a, b in token_store.cut_stream(body)}
    shifted = np.concatenate([rng.integers(0, 50_000, 777).astype("<u4"), body])
    cuts = token_store.cut_stream(shifted)
    assert [b for _, b in cuts[:-1]] == [a for a, _ in cuts[1:]] and cuts[0][0] == 0 and cuts[-1][1] == len(shifted)
    assert len(plain & {shifted[a:b].tobytes() for a, b in cuts}) >= len(plain) - 3


def test_library_encoder_keeps_its_words_apart():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = token_store.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=7)
    texts = ["one&&& two!! 'three' don't can't. x\nDu. y\n&& é... ²³ a_b __", "Ünï,### foo's? bar'll! 12%%% ١٢ .a -b- c'd'e", "漢字。 ok", "\u0301e e\u0301. ǅ! ªº..", "a\tb", "a\x1cb c", "a\u2003b"]
    assert [g.tolist() for g in encoder.encode(texts * 2)] == [e.ids for e in tokenizer.encode_batch(texts * 2, add_special_tokens=False)]


def test_library_encoder_calls_the_library_for_groups_of_new_heads():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer, calls = token_store.LibraryEncoder(path), Tokenizer.from_file(path), []
    tokenize = encoder.tokenize
    encoder.tokenize = lambda word: calls.append(word) or tokenize(word)
    rng = np.random.default_rng(5)
    heads = ["".join(rng.choice(list("aeinorstéß漢ж"), 9)) for _ in range(2000)]
    texts = [" ".join(heads[:900]) + "\n" + ".\n".join(heads[900:]), "".join(f" {h}," for h in heads)[1:], " ".join(f"{h}-{i}" for i, h in enumerate(heads))]
    for known in (False, True):
        assert [g.tolist() for g in encoder.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(calls) < 10 if known else len(calls) < 200
        calls.clear()


def test_library_encoder_takes_letters_as_the_tokenizer_does():
    split = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    every = pa.array([chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    letters = every.filter(pc.utf8_is_alpha(every)).to_pylist()
    assert len(letters) > 100_000
    assert [c for c in letters if [at for _, at in split(f" {c}{c}!")] != [(0, 3), (3, 4)]] == []


def test_library_encoder_where_a_token_reaches_over_a_blank():
    encoder = token_store.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [g.tolist() for g in encoder.encode(["one two\nthree x1 y2"])]
    encoder = token_store.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.starts[:] = False  # as if tokens held several heads: each is then encoded alone
    assert [g.tolist() for g in encoder.encode(["one two\nthree x1 y2"])] == want


def test_cuts_do_not_depend_on_the_streams_before():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 70, 5000, 3, 0, 64, 65, 12_000, 700)]
    found = list(token_store.cut_candidates(streams))
    assert [token_store.cut_stream(s, c) for s, c in zip(streams, found, strict=True)] == [token_store.cut_stream(s) for s in streams]
    assert list(token_store.cut_candidates([])) == []


def test_crc_of_parts_is_that_of_the_whole():
    rng = np.random.default_rng(4)
    docs = [[rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in sizes] for sizes in ([1], [64, 4096, 1], [500, 1], [1, 1, 1, 777, 2], [4095, 4096])]
    parts = [p for d in docs for p in d]
    shifts: dict[int, int] = {}
    for _ in range(2):
        got = token_store.crc_of_parts(np.array([len(p) // 4 for p in parts]), np.array([zlib.crc32(p) for p in parts]), np.array([len(d) for d in docs]), shifts)
        assert got.tolist() == [zlib.crc32(b"".join(d)) for d in docs]
    large = np.array([0, 1, 4, 4 << 20])
    assert [int(x) ^ zlib.crc32(bytes(n)) for n, x in zip(large, token_store._crc_products(token_store.crc_shifts(large), np.full(4, zlib.crc32(b"ab"), np.uint32)), strict=True)] == [zlib.crc32(b"ab" + bytes(int(n))) for n in large]


def test_lost_chunk_is_noticed(make_docs, spark):
    store = token_store.token_store(make_docs([(1, words("a", 90), "en", "s", 3), (2, None, "en", "s", 0)]))
    chunks = spark.read.parquet(store.path("chunks")).collect()
    store.drop("chunks")
    spark.createDataFrame(chunks[1:], "chunk_id binary, n_ids int, ids binary").write.parquet(store.path("chunks"))
    with pytest.raises(Exception, match="does not match its chunks"):
        token_store.read_digests(store).collect()


def many_parts(spark, make_docs):
    """A store whose recipes lie in several files, with repeated ids."""
    rows = [((i * 37) % 400, words(i % 90, i % 60) if i % 7 else None, "en", "s", 1) for i in range(600)]
    conf = {"spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return rows, token_store.token_store(make_docs(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_recipe_files_are_in_order(spark, make_docs):
    rows, store = many_parts(spark, make_docs)
    folder = store.path("recipes").removeprefix("file://")
    files = [pq.read_table(f).to_pylist() for f in sorted(glob.glob(f"{folder}/part-*"))]
    files = [f for f in files if f]
    assert len(files) >= 4
    assert [r["doc_id"] for f in files for r in f] == sorted(r[0] for r in rows)
    for f in files:
        assert {r["part"] for r in f} == {f[0]["part"]} and [r["row"] for r in f] == list(range(len(f)))
    ids_of = {t: Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t or "", add_special_tokens=False).ids for t in {r[1] for r in rows}}
    got = sorted(token_store.read_digests(store).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]]).tolist()[:-1]
    assert sum(r.n_tokens for r in got) == sum(len(ids_of[r[1]]) + 1 for r in rows)


@pytest.mark.parametrize("damage", ["lost", "swapped", "changed"])
def test_damaged_recipes_are_noticed(spark, make_docs, damage):
    _, store = many_parts(spark, make_docs)
    schema = spark.read.parquet(store.path("recipes")).schema
    recipes = sorted(spark.read.parquet(store.path("recipes")).collect(), key=lambda r: (r.part, r.row))
    if damage == "lost":
        recipes.pop(300)
    else:
        a = 300
        b = next(i for i in range(301, 600) if recipes[i].root != recipes[a].root)
        x, y = recipes[a].asDict(), recipes[b].asDict()
        moved = ("chunk_ids", "root", "n_ids") if damage == "changed" else ("chunk_ids", "root", "n_ids", "doc_id")
        recipes[a], recipes[b] = (Row(**{**p, **{k: q[k] for k in moved}}) for p, q in ((x, y), (y, x)))
    store.drop("recipes")
    spark.createDataFrame(recipes, schema).write.parquet(store.path("recipes"))
    for read in (token_store.read_digests, token_store.read_documents):
        with pytest.raises(ValueError, match="do not match the manifest"):
            read(store)


def test_damaged_chunk_is_noticed(make_docs, spark):
    store = token_store.token_store(make_docs([(1, "some text here", "en", "s", 3)]))
    chunks = spark.read.parquet(store.path("chunks")).withColumn("chunk_id", F.lit(b"0" * 16)).collect()
    store.drop("chunks")
    spark.createDataFrame(chunks, "chunk_id binary, n_ids int, ids binary").write.parquet(store.path("chunks"))
    with pytest.raises(Exception, match="does not hold"):
        token_store.read_chunks(store).collect()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(make_docs, odd_rows, library):
    rows = [*odd_rows, (50, "aaaaaaaaaa aaaaaaa ananananan don't  3½ \x1c\x85 <|endoftext|>", None, None, None)]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(make_docs(rows)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode()))] += 1
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(make_docs(rows))).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in rows)


def test_merge_replay_equals_merging_alone():
    replay = bpe.codec(public_tokenizers.path(bpe.RANK_FILE)).replay
    rng = np.random.default_rng(2)
    made = [bytes(rng.choice(list(b"abcdethinrso  AB12"), rng.integers(1, 25)).tolist()) for _ in range(3000)] + [b"a" * n for n in range(1, 40)]
    assert [list(x) for x in replay.encode_words(made)] == [replay.encode_alone(w) for w in made]


def test_fingerprints(make_docs, odd_rows):
    # Rows with equal ids are ordered by a hash, so ids are made distinct here.
    rows = [(i, *r[1:]) for i, r in enumerate(odd_rows)]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = [fingerprints.fingerprint(t) for t in (text, edited, after)]
        assert [got[i].fingerprint, got[i].edited_fingerprint] == prints[:2]
        a, b, c = map(fingerprints.from_text, prints)
        assert (got[i].near_edited, got[i].near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    repeated = fingerprints.edited_likeness(make_docs(odd_rows)).collect()
    assert Counter(r.doc_id for r in repeated) == Counter(r[0] for r in odd_rows)


def plain_fingerprint(text, most):
    """By phrases as byte strings; the dictionary starts anew at `most` phrases."""
    known, phrases, phrase = set(), set(), b""
    for c in text.encode():
        phrase += bytes([c])
        if phrase not in known:
            known.add(phrase)
            phrases.add(phrase)
            phrase = b""
            if len(known) == most:
                known = set()
    phrases |= {phrase} if phrase else set()
    least = {}
    for p in phrases:
        h = 1
        for c in p:
            h = (h * fingerprints._FACTOR + c + 1) % (1 << 61)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ h >> shift) * factor % (1 << 64)
        least[h >> 57] = min(h, least.get(h >> 57, h))
    out = ""
    for bin in range(fingerprints.BINS if least else 0):
        steps = next(d for d in range(fingerprints.BINS) if (bin + d) % fingerprints.BINS in least)
        h = least[(bin + steps) % fingerprints.BINS] + steps
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ h >> shift) * factor % (1 << 64)
        out += f"{h & 0xFFFF:04x}"
    return out


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_fingerprints_equal_a_plain_parse(monkeypatch, most):
    monkeypatch.setattr(fingerprints, "MAX_PHRASES", most)
    rng = np.random.default_rng(1)
    texts = ["", "a", "aaaa", "naïve 漢字", words("f", 30), "".join(rng.choice(list("abc "), 3000))]
    assert [fingerprints.fingerprint(t) for t in texts] == [plain_fingerprint(t, most) for t in texts]


def brute_classes(rows):
    """Components over plain comparisons of all distinct texts, on word tuples, with weights by exact document frequencies."""
    n, frequencies = len(rows), Counter()

    def shingled(text):
        own = text.lower().split()
        return Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else Counter()

    for r in rows:
        frequencies.update(set(shingled(r[1] or "")))
    texts = sorted({r[1] or "" for r in rows})
    damped = lambda s: 1 + near_dedup.IDF_SHARE * max(0.0, np.log((n + 2) / (frequencies[s] + 1))) / np.log(n + 2)
    sets = [{s: c * damped(s) for s, c in shingled(t).items()} for t in texts]

    def likeness(a, b):
        both = a.keys() | b.keys()
        return sum(min(a.get(s, 0), b.get(s, 0)) for s in both) / sum(max(a.get(s, 0), b.get(s, 0)) for s in both) if both else 0.0

    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for j in range(i):
            if sets[i].keys() & sets[j].keys() and likeness(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                root[find(a)] = find(texts[j])
    least = {}
    for r in sorted(rows, key=order):
        least.setdefault(find(r[1] or ""), r[0])
    return Counter((r[0], least[find(r[1] or "")]) for r in rows)


def near_rows():
    base = words("n", 200).split()
    copies = []
    for i in range(12):
        copy = list(base)
        copy[10 * i + 3] = f"changed{i}"
        copies.append(" ".join(copy))
    half = " ".join(base[:100]) + " " + words("h", 100)
    rows = [(100 + i, t, "en", "s", 1) for i, t in enumerate([*copies, half, words("z", 80), words("z", 80).upper()])]
    return rows + [rows[0], (5, copies[3], None, None, None)]


def test_near_duplicates(make_docs, odd_rows):
    rows = [*odd_rows, *near_rows()]
    got = near_dedup.near_duplicates(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes([(r[0], r[1]) for r in rows])
    kept = near_dedup.drop_near_duplicates(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    classes = near_dedup.near_duplicates(kept).collect()
    found = brute_classes([(i, r[1]) for i, r in enumerate(rows)])
    assert len(classes) == len({c for _, c in found}) and all(r.kept for r in classes)


def test_near_duplicates_of_many_clusters_in_a_bucket(make_docs, monkeypatch):
    """All texts in one bucket: clusters with no link to its heads, chains, and links between members of different heads."""
    rng, rows = np.random.default_rng(6), []
    for i in range(25):
        base = words(f"c{i}", 150).split()
        rows += [(len(rows) + k, " ".join([*base[:140], f"end{i}x{k}"]), "en", "s", 1) for k in range(3)]
    base = words("g", 150).split()
    for _ in range(60):
        copy = list(base)
        for at in rng.choice(150, rng.integers(0, 7), replace=False):
            copy[at] = f"new{rng.integers(0, 10**6)}"
        rows.append((len(rows), " ".join(copy), "en", "s", 1))
    for i in range(12):  # each is similar to the next one only
        rows.append((len(rows), words("chain", 400).split(" ", 20 * i)[-1].rsplit(" ", 20 * (12 - i))[0], "en", "s", 1))
    signed = near_dedup.candidate_bands

    def one_bucket(docs, work, weights):
        return signed(docs, work, weights).withColumn("bands", F.array(F.lit(1).cast("long")))

    monkeypatch.setattr(near_dedup, "candidate_bands", one_bucket)
    want = brute_classes([(r[0], r[1]) for r in rows])
    got = near_dedup.near_duplicates(make_docs(rows)).collect()
    assert len({c for _, c in want}) < len(rows) - 50
    assert Counter((r.doc_id, r.class_id) for r in got) == want


def near_group(n):
    """n near copies: one half has two changes each, each of the other half those of one of them and four more, so that it is
    similar to that one and hardly to any other."""
    base, rows = words("hot", 240).split(), []
    for i in range(n):
        own, copy = i % (n // 2), list(base)
        for k in range(2 if i < n // 2 else 6):
            copy[(7 * own + 37 * k) % 240] = f"own{own}x{k}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    return rows


def test_a_group_of_near_copies_is_not_compared_in_all_pairs(make_docs, monkeypatch):
    signed, plausible, compared = near_dedup.candidate_bands, near_dedup.plausible, []

    def one_bucket(docs, work, weights):
        return signed(docs, work, weights).withColumn("bands", F.array(F.lit(1).cast("long")))

    def counted(pairs, samples):
        compared.append(pairs.count())
        return plausible(pairs, samples)

    monkeypatch.setattr(near_dedup, "candidate_bands", one_bucket)
    monkeypatch.setattr(near_dedup, "plausible", counted)
    rows = near_group(160)
    got = near_dedup.near_duplicates(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes([(r[0], r[1]) for r in rows])
    assert sum(compared) <= 6 * len(rows), compared


def test_a_component_of_many_links_does_not_meet_itself(make_docs, monkeypatch):
    """A chain of texts, each similar to the next ones only: one component, whose ends are many links apart."""
    links, pairs = near_dedup.verify, []

    def chain(found, texts, weights):
        if not pairs:  # the first links, in place of those with heads of buckets
            keys = sorted(r.key for r in texts.select("key").collect())
            found = texts.sparkSession.createDataFrame([(b, a) for a, b in zip(keys, keys[1:])], found.schema)
            pairs.append(0)
            return found
        pairs.append(found.count())
        return links(found, texts, weights)

    monkeypatch.setattr(near_dedup, "verify", chain)
    rows = near_group(40)
    got = near_dedup.near_duplicates(make_docs(rows)).collect()
    assert {r.class_id for r in got} == {0} and len(pairs) >= 2 and not any(pairs)


def test_sampling_estimates_weighted_jaccard():
    rng, sampler = np.random.default_rng(4), near_dedup.Sampler()
    hashes = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    weights = rng.uniform(1, 8, len(hashes))
    a, b = (hashes[:200], weights[:200]), (hashes[60:260], weights[60:260])
    want = near_dedup.weighted_jaccard(a, b)
    hits = same = trials = 0
    for seed in range(40):
        sampler = near_dedup.Sampler(seed)
        (one, ones), (two, twos) = (sampler.bands(*x) for x in (a, b))
        hits += int((one == two).sum())
        same += int((np.frombuffer(ones, "<u2") == np.frombuffer(twos, "<u2")).sum())
        trials += near_dedup.BANDS
    assert abs(hits / trials - want**near_dedup.BAND_ROWS) < 0.05 and abs(same / (trials * near_dedup.BAND_ROWS) - want) < 0.03
    again = sampler.bands(a[0].copy(), a[1].copy())
    assert (sampler.bands(*a)[0] == again[0]).all() and sampler.bands(*a)[1] == again[1]


def brute_spans(rows):
    rows = sorted({(r[0], r[1] or "") for r in rows}, key=order)
    first, marked = {}, set()
    cut = {r: r[1].split() for r in rows}
    ranked = {r: (order(r), i) for i, r in enumerate(rows)}
    for r in rows:
        for s in range(len(cut[r]) - suffix_dedup.MIN_WORDS + 1):
            first.setdefault(tuple(cut[r][s : s + suffix_dedup.MIN_WORDS]), r)
    for r in rows:
        for s in range(len(cut[r]) - suffix_dedup.MIN_WORDS + 1):
            if first[tuple(cut[r][s : s + suffix_dedup.MIN_WORDS])] != r:
                marked |= {(r, p) for p in range(s, s + suffix_dedup.MIN_WORDS)}
    return marked, ranked


def test_repeated_passages(make_docs, odd_rows):
    long, short = words("q", 51), words("r", 49)
    rows = [(i, *r[1:]) for i, r in enumerate(odd_rows)]
    rows += [(100 + i, f"{words(f'u{i}', 7 * i)} {long} {words(f'v{i}', 20)} {short}", "en", "s", 1) for i in range(6)]
    rows += [(200, long + " " + words("t", 9) + " " + words("r", 49) + " " + words("t", 9), "en", "s", 1)]
    marked, _ = brute_spans(rows)
    got = suffix_dedup.repeated_spans(make_docs(rows)).collect()
    assert {(r.doc_id, p) for r in got for p in range(r.start_word, r.start_word + r.n_words)} == {(r[0], p) for r, p in marked}
    assert all(r.first_doc_id < r.doc_id for r in got)
    cut = {r.doc_id: r for r in suffix_dedup.drop_repeated_passages(make_docs(rows)).collect()}
    for r in rows:
        kept = [w for p, w in enumerate((r[1] or "").split()) if ((r[0], r[1] or ""), p) not in marked]
        assert (cut[r[0]].text or "").split() == kept and (cut[r[0]].text is None) == (r[1] is None)
    assert Counter(r.doc_id for r in suffix_dedup.drop_repeated_passages(make_docs(odd_rows)).collect()) == Counter(r[0] for r in odd_rows)


def test_every_run_belongs_to_one_suffix():
    rng = np.random.default_rng(6)
    for text in (" ".join(f"w{x}" for x in rng.integers(0, 400, 3000)), " ".join(["a", "b"] * 200), "x " * 51):
        found, n = suffix_dedup.Suffixes(text), len(text.split())
        runs = [a - left for a, l, r in zip(found.at, found.left, found.right, strict=True) for left in range(suffix_dedup.MIN_WORDS - r, l + 1)]
        assert sorted(runs) == list(range(n - suffix_dedup.MIN_WORDS + 1))
        assert (found.right >= suffix_dedup.KEY_WORDS).all() and (found.left <= suffix_dedup.REACH).all()


@pytest.mark.parametrize("cell_docs", [4096, 4])
def test_repeated_passages_of_many_documents(make_docs, monkeypatch, cell_docs):
    """Hot passages with many contexts, near copies, periodic texts, passages that start or end where others go on; with
    the documents of a key in one task or dealt to several."""
    monkeypatch.setattr(suffix_dedup, "CELL_DOCS", cell_docs)
    rng, rows = np.random.default_rng(11), []
    body, hot = words("body", 300).split(), words("hot", 60).split()
    for i in range(50):
        a, b = sorted(rng.integers(0, 300, 2).tolist())
        copy = body[a:b]
        for at in rng.integers(0, max(1, len(copy)), 3 if i % 2 else 0).tolist():
            copy[at : at + 1] = [f"e{i}x{at}"] if copy else []
        text = [*words(f"l{i}", int(rng.integers(0, 40))).split(), *copy, *words(f"m{i}", int(rng.integers(0, 5))).split()]
        text += hot[int(rng.integers(0, 15)) : 60 - int(rng.integers(0, 3))] if i % 3 else []
        rows.append((i, " ".join([*text, *words(f"r{i}", int(rng.integers(0, 40))).split()]), "en", "s", 1))
    rows += [(60 + i, " ".join(["la", "li", "lu"][: 1 + i % 3] * 70), "en", "s", 1) for i in range(7)]
    rows += [(70 + i, " ".join(body), "en", "s", 1) for i in range(9)] + [rows[3]]
    marked, _ = brute_spans(rows)
    got = suffix_dedup.repeated_spans(make_docs(rows)).collect()
    assert {(r.doc_id, p) for r in got for p in range(r.start_word, r.start_word + r.n_words)} == {(r[0], p) for r, p in marked}
    held = {r[0]: r[1].split() for r in rows}
    for r in got:
        run = held[r.doc_id][r.start_word : r.start_word + suffix_dedup.MIN_WORDS]
        first = held[r.first_doc_id]
        assert r.first_doc_id < r.doc_id and any(first[s : s + len(run)] == run for s in range(len(first)))


def water_fill(sizes):
    """Targets by the rule as it is told: share, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        capped = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not capped:
            return target | share
        for s in capped:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= capped
    return target


def test_mixing(make_docs, odd_rows, spark):
    rows = [*odd_rows, *[(1000 + i, words(i, 1 + i % 50), "en", ["big", "mid", "tiny", "B", "é"][min(4, i % 17)], 0) for i in range(1500)]]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").replace(" ", " ").split())
    target = water_fill(sizes)
    taken = Counter()
    for r in got:
        assert r["__sift_size"] == len((r["text"] or "").split()) and 0 <= r["__sift_times"] <= 3
        assert r["__sift_source_size"] == sizes[r["source"]] and r["__sift_target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["__sift_size"] * r["__sift_times"]
    for s in ("big", "mid", "tiny", "B", "é"):
        assert abs(taken[s] - target[s]) <= 50
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["text"], r["__sift_times"]) for r in again) == Counter((r["doc_id"], r["text"], r["__sift_times"]) for r in got)
    assert mixing.mixed_rows(docs).count() == sum(r["__sift_times"] for r in got)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")


def test_chat_snapshots(spark):
    said = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x"), ("user", "")]
    rows = []
    for conv, n in ((1, 2), (2, 5), (3, 5), (4, 4), (None, 3)):
        rows += [(conv, i * (3 if conv == 4 else 1), r, t, "p") for i, (r, t) in enumerate(said[:n])]
    rows += [(5, i, "user", f"long {i}", "p") for i in range(200)] + [(6, i, "user", f"long {i}", "p") for i in range(130)]
    rows += [(7, None, "user", "no turn", None), (7, 0, "user", "then", None), (7, 0, "user", "then", None)]
    got = chat.collapse_and_render(conversations(spark, rows)).collect()
    kept = {r.conv_id: (r.n_turns, r.n_equal) for r in got}
    assert kept == {2: (5, 2), 5: (200, 1), 7: (3, 1)}
    text = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 5), key=lambda r: r.part))
    assert text == "".join(f"<|user|>\nlong {i}\n<|end|>\n" for i in range(200))
    assert next(r.rendered for r in got if r.conv_id == 2).startswith("<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\n\n<|end|>\n<|unknown|>")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    rows += [(10_000 + i, data[0].tolist(), 0) for i in range(40)]
    rows += [(None, data[1].tolist(), 0), (9000, None, 0), (9100, [0.0] * 16, 0), (9200, [float("nan")] * 16, 0), (9300, [None] * 16, 0), (9400, [1.0], 0), (5, data[5].tolist(), 1)]
    valid = neighbours.valid_vectors(vectors(spark, rows), "vec_id", "embedding")
    got = {}
    for r in neighbours.search(valid, valid.filter("id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([r[0] for r in rows[:3040]])
    points = np.array([r[1] for r in rows[:3040]], dtype=np.float64)
    asked = [i for i in ids if i % 100 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for i in asked:
        at = int(np.flatnonzero(ids == i)[0])
        distance = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        distance[at] = np.inf
        best = np.lexsort((ids, distance))[:10]
        found = sorted(got[i])
        assert [f[0] for f in found] == list(range(1, 11)) and i not in [f[1] for f in found]
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len({int(ids[b]) for b in best} & {f[1] for f in found})
    assert hits >= 0.9 * 10 * len(asked)
    assert [f[1] for f in sorted(got[0])] == list(range(10_000, 10_010))


def test_tree_visits_every_leaf_once():
    rng = np.random.default_rng(9)
    tree = neighbours.Tree(rng.normal(size=(2000, 8)))
    assert sorted(tree.visit(rng.normal(size=8), 10**6)) == list(range(tree.n_leaves))
    assert len(neighbours.Tree(np.ones((500, 4))).leaf) == 1


LABELS = "doc_id long, quality int, toxic int, score string"


def labelled(n=600):
    rng = np.random.default_rng(10)
    plain = [f"word{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(n):
        # Some words are new in every document, as in any real corpus.
        text = ["".join(rng.choice(list("abcdefghnrstuwx0123"), 6)) if rng.random() < 0.3 else w for w in rng.choice(plain, rng.integers(20, 90)).tolist()]
        toxic, junk = bool(rng.random() < 0.25), bool(rng.random() < 0.2)
        if toxic:
            for _ in range(3):
                text.insert(int(rng.integers(0, len(text))), f"zorgak{rng.choice(list('abcdefgh'))}{rng.integers(0, 30)}")
        body = " ".join(w.upper() + "!!" for w in text) if junk else " ".join(text)
        rows.append((i, body, "en", "s", len(body)))
        labels.append((i, 0 if junk else 1, int(toxic), "s"))
    return rows, labels


def test_quality(make_docs, odd_rows, spark):
    rows, labels = labelled()
    table = spark.createDataFrame([*labels, (None, 1, 1, "s"), (3, None, None, "s")], LABELS)
    got = quality.score_quality(make_docs([*rows, *odd_rows]), table).collect()
    assert len(got) == len(rows) + len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {x[0]: x[1] for x in labels[20:]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_rules_equal_a_numpy_evaluation(make_docs, odd_rows, spark):
    rows, labels = labelled(200)
    described = quality.with_statistics(make_docs([*rows, *odd_rows])).cache()
    model = quality.fit_quality(described, spark.createDataFrame(labels, LABELS))
    assert model.rules
    told = described.withColumn("score", model.score()).collect()
    for r in told:
        total = model.intercept
        for rule in model.rules:
            if all((r[name] > t) == above for name, above, t in rule.tests):
                total += rule.weight
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
    text = "Ab c!! ### d&& e&& e 12 É.\n\nx"
    one = quality.with_statistics(make_docs([(1, text, "en", "s", 1)])).first()
    cut = text.split()
    assert one["capital_share"] == pytest.approx(2 / 8) and one["digit_share"] == pytest.approx(2 / len(text))
    assert one["exclaimed_share"] == pytest.approx(1 / len(cut)) and one["symbol_word_share"] == pytest.approx(1 / len(cut))
    assert one["symbol_tail_share"] == pytest.approx(3 / len(cut)) and one["chars_per_line"] == pytest.approx(len(text) / 3)
    assert one["log_words"] == pytest.approx(np.log1p(len(cut)))


def test_statistics_of_long_runs_take_one_pass(make_docs):
    began = time.monotonic()
    runs = ["#" * 1_000_000 + "a", "! " * 300_000, "a" * 1_000_000, "#." * 400_000, "x y " * 250_000]
    rows = quality.with_statistics(make_docs([(i, t, "en", "s", 1) for i, t in enumerate(runs)])).collect()
    assert len(rows) == len(runs) and time.monotonic() - began < 60


def test_toxicity(make_docs, odd_rows, spark):
    rows, labels = labelled()
    table = spark.createDataFrame(labels, LABELS)
    docs = make_docs([*rows, *[r for r in odd_rows if r[0] is None or r[0] not in range(20)]])
    model = toxicity.fit_toxicity(docs, table, toxicity.Workspace(spark, "toxicity"))
    got = toxicity.score_documents(docs.select("doc_id", "text"), *model).collect()
    truth = {x[0]: x[2] for x in labels}
    held = [(r["__sift_toxicity"], truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) >= 0.9 * len(held)
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns and all(r.toxicity == "x" for r in kept.collect())


def test_toxicity_learns_from_long_documents(make_docs, spark):
    """All labelled documents have hundreds of words: the network is trained on windows of each."""
    rng = np.random.default_rng(12)
    rows, labels = labelled()
    filler = [f"filler{i}" for i in range(200)]
    long = []
    for r in rows:
        before, after = (" ".join(rng.choice(filler, 150).tolist()) for _ in range(2))
        long.append((r[0], f"{before} {r[1]} {after}", *r[2:]))
    docs, table = make_docs(long), spark.createDataFrame(labels, LABELS)
    net, mapping = toxicity.fit_toxicity(docs, table, toxicity.Workspace(spark, "toxicity"))
    start = toxicity.Network(np.zeros(toxicity.WORD_BUCKETS), np.zeros(toxicity.GRAM_BUCKETS))
    assert all(np.abs(net.p[k] - start.p[k]).max() > 1e-3 for k in ("pool", "out", "wf", "uf", "wb", "ub"))
    truth = {x[0]: x[2] for x in labels}
    got = toxicity.score_documents(docs.select("doc_id", "text"), net, mapping).collect()
    held = [(r["__sift_toxicity"] >= 0.5, bool(truth[r.doc_id])) for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def plain_score(net, text):
    """The highest window's logit by loops over words, one window at a time."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    H, words = toxicity.HIDDEN, toxicity.words_of(text)
    vectors = []
    for w in words:
        own = toxicity.Inputs([w])
        vectors.append(np.concatenate([net.p["words"][own.words[0]], net.p["grams"][own.grams].max(axis=0)]))
    last = max(0, len(words) - toxicity.WINDOW)
    best = -np.inf
    for start in sorted({*range(0, last, toxicity.STRIDE), last}) if words else []:
        window, states = vectors[start : start + toxicity.WINDOW], {}
        for side in "fb":
            h, states[side] = np.zeros(H), {}
            for t in range(len(window)) if side == "f" else reversed(range(len(window))):
                given = window[t] @ net.p[f"w{side}"] + net.p[f"c{side}"]
                own = h @ net.p[f"u{side}"]
                z, r = sigmoid(given[:H] + own[:H]), sigmoid(given[H : 2 * H] + own[H : 2 * H])
                h = h + z * (np.tanh(given[2 * H :] + r * own[2 * H :]) - h)
                states[side][t] = h
        both = np.array([np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(window))])
        weight = np.exp(both @ net.p["pool"])
        best = max(best, (weight / weight.sum()) @ both @ net.p["out"] + net.p["bias"][0])
    return best


def test_batched_windows_equal_plain_loops():
    rng = np.random.default_rng(3)
    net = toxicity.Network(*(rng.normal(size=n).astype(np.float32) for n in (toxicity.WORD_BUCKETS, toxicity.GRAM_BUCKETS)))
    texts = ["", " ", "x", "x" * 5000, "naïve Été 漢字 🙂 a b", *(words(f"s{n}", n) for n in (1, 40, 63, 64, 65, 96, 97, 300))]
    got = toxicity.Scorer(net, most=100).logits(texts)
    want = [plain_score(net, t) for t in texts]
    assert got == pytest.approx(want, abs=1e-3)


def test_word_inputs_are_those_of_each_word_alone():
    made = ["a", "to", "naïve", "漢字", "x" * 3000, "word12"]
    together = toxicity.Inputs(made)
    some = together.take(np.array([4, 0, 4]))
    for at, (w, own) in enumerate([(w, together) for w in made] + [(made[i], some) for i in (4, 0, 4)]):
        i, alone = at if at < len(made) else at - len(made), toxicity.Inputs([w])
        assert own.words[i] == alone.words[0] and own.grams[own.ends[i] - own.sizes[i] : own.ends[i]].tolist() == alone.grams.tolist()
        assert len(alone.grams) == sum(max(0, len(w) + 2 - n + 1) for n in toxicity.GRAMS)


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.zeros(toxicity.WORD_BUCKETS), np.zeros(toxicity.GRAM_BUCKETS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("words", "grams")}
    x, mask, y = rng.normal(size=(7, 4, 6)), np.ones((7, 4, 1)), np.array([0.0, 1.0, 1.0, 0.0])
    mask[5:, 1] = 0

    def loss():
        projected = {s: x @ net.p[f"w{s}"] + net.p[f"c{s}"] for s in "fb"}
        q = toxicity.sigmoid(net.logits(projected, mask)[0].astype(np.float64))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    grads, _ = net.gradients(x, mask, y, np.ones(4))
    for k in ("wf", "ub", "cf", "pool", "out", "uf", "wb"):
        at = np.unravel_index(3, net.p[k].shape)
        held = net.p[k][at]
        net.p[k][at] = held + 1e-2
        up = loss()
        net.p[k][at] = held - 1e-2
        down = loss()
        net.p[k][at] = held
        assert grads[k][at] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=1e-6)


def test_empty_tables(make_docs, spark):
    docs, labels = make_docs([]), spark.createDataFrame([], LABELS)
    assert token_store.read_digests(token_store.token_store(docs)).count() == 0
    assert bpe.digest_documents(docs).count() == 0
    assert fingerprints.edited_likeness(docs).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0
    assert suffix_dedup.drop_repeated_passages(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert chat.collapse_and_render(conversations(spark, [])).count() == 0
    assert quality.score_quality(docs, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).count() == 0
    valid = neighbours.valid_vectors(vectors(spark, []), "vec_id", "embedding")
    assert neighbours.search(valid, valid).count() == 0


def test_single_document(make_docs):
    docs = make_docs([(3, "only one", "en", "s", 8)])
    row = fingerprints.edited_likeness(docs).collect()[0]
    assert row.near_next == 1.0
    assert [r["__sift_times"] for r in mixing.mix(docs).collect()] == [1]
