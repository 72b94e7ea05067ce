import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinfold.llm import bpe_chunks, storage, token_counts, token_files, token_transducer, wordbpe

PATH = wordbpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
random.seed(3)
LETTERS = "ab'slLt. \n\tÉéſΣ9½中<|>\x1c\x85\xa0́"
TEXTS = [
    None, "", "   ", "a\x0bb", "a\x1cb", "don't DON'T it''s !'s 'll'vex'dog ''' rock'n'roll 'sst", "x<|endoftext|>y <|startoftext|><|endoftext|> <|ENDOFTEXT|>",
    "é é ̈x", "ΑΣ ΣΑΣ İstanbul", "½ ⅷ ٣ 中文字 日本 ñ", "x　y﻿z", "𝟘𝓍 😀👍🏽x", "a" * 5000, "ab" * 3000 + " " + "é" * 4000, "the quick brown fox " * 400,
    *("".join(random.choice(LETTERS) for _ in range(random.randint(0, 400))) for _ in range(150)),
]
WANT = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_pretokens_and_library_merges():
    assert [x.tolist() for x in wordbpe.encoder(PATH).encode(TEXTS)] == WANT
    for t, w in zip(TEXTS[:20], WANT):
        assert wordbpe.encoder(PATH).encode([t])[0].tolist() == w


def test_memo_of_any_size_gives_the_same():
    small = wordbpe.PretokenEncoder(PATH, remembered=3)
    for _ in range(3):
        assert [x.tolist() for x in small.encode(TEXTS)] == WANT


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        wordbpe.Spec(wordbpe.vocabulary_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk", [1, 3, 64, 256])
def test_transducer(chunk):
    machine = token_transducer.Transducer(PATH, chunk=chunk)
    plain = [t for t in TEXTS if t is not None and "<|" not in t]
    symbols, bounds = token_transducer.symbols_of(plain)
    tokens, emitted = machine.run(symbols)
    upto = np.concatenate(([0], np.cumsum(emitted, dtype=np.int64)))
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in plain]
    assert (upto[bounds[1:]] - upto[bounds[:-1]]).tolist() == [len(w) for w in want]
    names = machine.spec.names
    lengths = np.array([len(n.removesuffix("</w>")) if n.removesuffix("</w>") else len(n) for n in names])
    ids, _ = token_transducer.ids_of(symbols, tokens, lengths)
    assert ids.tolist() == [i for w in want for i in w]


def test_state_maps_compose():
    """The scan's maps are those of one chunk after the other."""
    rng = np.random.default_rng(6)
    for chunks, states in ((1, 1), (2, 3), (7, 4), (64, 5), (100, 2)):
        maps, emitted = rng.integers(0, states, size=(chunks, states)), rng.integers(-3, 9, size=(chunks, states))
        got, total = token_transducer.compose(maps, emitted)
        at, n = np.arange(states), np.zeros(states, dtype=np.int64)
        for k in range(chunks):
            n, at = n + emitted[k, at], maps[k, at]
            assert (got[k] == at).all() and (total[k] == n).all()


def test_random_chunk_borders():
    """Counts don't depend on where chunks end, within long words either."""
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 5000, 40, 900)] + ["a" * 3000 + "b" * 300, "ab" * 700 + " x"]
    want = [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in plain]
    symbols, bounds = token_transducer.symbols_of(plain)
    for chunk in rng.sample(range(1, 700), 12):
        upto = np.concatenate(([0], np.cumsum(token_transducer.Transducer(PATH, chunk=chunk).run(symbols, want_tokens=False)[1], dtype=np.int64)))
        assert (upto[bounds[1:]] - upto[bounds[:-1]]).tolist() == want


def test_all_code_points():
    """Ids and counts of every code point, alone and among letters, are the library's, whatever Unicode tables Python has."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x30000 or c % 97 == 0)]
    for a in range(0, len(points), 8192):
        texts = [f"a{chr(c)}b {chr(c)} É{chr(c)}{chr(c)}1" for c in points[a : a + 8192]]
        want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in wordbpe.encoder(PATH).encode(texts)] == want
        assert token_counts.count_texts(PATH, texts).tolist() == [len(w) for w in want]


def test_words_made_to_share_a_hash():
    """Thue-Morse words and their complements collide under any polynomial hash modulo 2**64."""
    one = ["a"]
    for _ in range(11):
        one += ["b" if c == "a" else "a" for c in one]
    text = "".join(one) + " " + "".join("b" if c == "a" else "a" for c in one)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in wordbpe.encoder(PATH).encode(["x", text, None])] == [LIBRARY.encode("x", add_special_tokens=False).ids, want, []]


def test_transducer_begins_anew_when_full():
    machine = token_transducer.Transducer(PATH, most_cells=1)
    symbols, bounds = token_transducer.symbols_of(["hello world", "again and again"])
    for _ in range(3):
        _, emitted = machine.run(symbols)
        assert emitted.sum() == 5


def test_token_counts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 2), (0, None, 3)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.token_counts(df, PATH, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), len(w), len(w) > 100) for i, (t, w) in enumerate(zip(TEXTS, WANT))] + [(None, 1, 1, False), (0, 0, 0, False)]
    assert got == sorted(want, key=str)


def test_joined_pieces():
    """Texts cut anywhere and put together again, whatever stands at the joins."""
    joined, decoder, rng = bpe_chunks.Joined(PATH), bpe_chunks.Decoder(PATH), random.Random(4)
    assert all(decoder.decode(w).decode() == LIBRARY.decode(w, skip_special_tokens=False) for w in WANT)
    for most in (1, 5, 60, 1000):
        cut = []
        for t in TEXTS:
            raw, at = (t or "").encode(), [0]
            while at[-1] < len(raw):
                at.append(min(len(raw), at[-1] + rng.randint(1, most)))
                while at[-1] < len(raw) and raw[at[-1]] & 0xC0 == 0x80:
                    at[-1] += 1
            cut.append(joined.pieces([raw[a:b] for a, b in zip(at, at[1:])]))
        assert [x.tolist() if x.size else [] for x in joined.join([c or joined.pieces([b""]) for c in cut])] == WANT


def test_windows_grow_until_they_agree():
    joined = bpe_chunks.Joined(PATH)
    left, right = joined.pieces([b"one two three fo", b"ur five six seven"])
    wrong = right._replace(ids=right.ids[::-1].copy())
    with pytest.raises(ValueError):
        joined.join([[left, wrong]])
    assert joined.join([[left, right]])[0].tolist() == LIBRARY.encode("one two three four five six seven", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_chunks_are_encoded_once(spark, bits, monkeypatch):
    """A passage in documents of different tasks: its chunks are one row each, and with a full filter, that lets all through, ids are the same."""
    monkeypatch.setattr(bpe_chunks, "FILTER_BITS", bits)
    rng = random.Random(9)
    passage = " ".join(f"{rng.random()}" for _ in range(900))
    texts = [f"own words {i} {passage} and {i * i} after" if i % 2 else passage[i * 7 :] for i in range(40)] + [None, "", "short", passage * 3, passage * 3]
    df = spark.createDataFrame([(i % 30 or None, t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, number long, k0 long").repartition(8)
    count = {}
    for t in texts:
        for c in bpe_chunks.chunks_of(t):
            count[c] = count.get(c, 0) + 1
    rows = df.select("doc_id", "text")
    read = bpe_chunks._read(rows, PATH, ["n_tokens"], bpe_chunks.shared_chunks(rows))
    got = [(r["k0"], r["k1"]) for r in bpe_chunks.encoded_chunks(read, PATH).collect()]
    assert len(got) == len(set(got)) and {bpe_chunks.digest(c) for c, n in count.items() if n > 1} <= set(got) <= {bpe_chunks.digest(c) for c in count}
    assert bits == 64 or len(got) == sum(n > 1 for n in count.values()) > 5
    want = [(i % 30 or -1, LIBRARY.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)]
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in bpe_chunks.encode_decode(df, PATH, ["ids"]).collect()) == sorted(want)
    assert bpe_chunks.encode_decode(df.limit(0), PATH, ["ids", "decoded"]).count() == 0


def test_chunks_and_decoding(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string")
    got = bpe_chunks.encode_decode(df, PATH, ["n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded"]).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        w = WANT[r["doc_id"]]
        assert r["ids"] == w and r["n_tokens"] == len(w) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest()
        assert r["decoded"] == LIBRARY.decode(w, skip_special_tokens=False) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1024, 1025, 300_000):
        for top in (1, 2, 300, 49407, 2**32 - 1):
            x = rng.integers(0, top, size=n, dtype=np.uint64).astype(np.uint32)
            x[: n // 50] = 2**32 - 1
            blocks = token_files.pack_blocks(x)
            starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:-1].astype(int).tolist()
            assert (token_files.unpack_blocks(memoryview(b"".join(blocks)), starts) == x).all()


def test_token_files(spark, tmp_path):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS seq", "text AS uri", "doc_id AS start", "doc_id AS ids")
    manifest = token_files.write_tokens(df, f"file://{tmp_path}/t", PATH, file_bytes=2_000)
    assert manifest.count() > 8
    got = sorted(map(tuple, token_files.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert [r[0] if r[0] is not None else -1 for r in got] == sorted(r[0] if r[0] is not None else -1 for r in rows)
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])))[:-1].tolist()
    crc = lambda t: zlib.crc32(np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())
    assert sorted((r[0] or -1, r[3]) for r in got) == sorted((d or -1, crc(t)) for d, t in rows)
    empty = token_files.write_tokens(df.limit(0), storage.new_folder(spark, "empty"), PATH)
    assert token_files.read_tokens(empty).count() == 0


@pytest.mark.parametrize("collide", [False, True])
def test_equal_stretches_get_one_number(monkeypatch, collide):
    """Also where they differ in zero bytes, past the 64th byte or in length alone, and where all keys are equal."""
    if collide:
        monkeypatch.setattr(wordbpe, "_ODD", np.uint64(0))
        monkeypatch.setattr(wordbpe, "_ODD2", np.uint64(0))
    rnd = random.Random(5)
    kinds = [b"a", b"a\0", b"\0", b"abcdefgh", b"abcdefgh\0", b"abcdefgh" * 8, b"abcdefgh" * 8 + b"x", b"abcdefgh" * 8 + b"y", b"z" * 63, b"z" * 64, b"z" * 65, b"z" * 1000, b"z" * 999 + b"y"]
    kinds += [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 30))) for _ in range(300)]
    words = [rnd.choice(kinds) for _ in range(3000)]
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    codes, first = wordbpe.different(b" ".join(words), np.concatenate([[0], end[:-1] + 1]), end)
    assert len(first) == len(set(words)) == len(set(codes.tolist()))
    assert [words[i] for i in first[codes]] == words
