"""The operators' inner parts against plain Python."""

import base64
import random
import struct
import zlib

import numpy as np
import pytest

import pyarrow as pa
from pyspark.sql import functions as F
import public_tokenizers
from medialake.llm import common, decontaminate, media, neardup, secret_scan, substring, tokens, toxicity
from medialake.llm.bpe import ByteBPE


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_png_round_trip():
    for raw in (b"", b"a", b"x" * 64, "é€😀".encode() * 500):
        payload, n = media.decode_png(media.encode_png(raw))
        assert payload == media.pad(raw) and n == len(raw) and len(payload) % 64 == 0 and payload


def test_png_damage_is_seen():
    good = bytearray(media.encode_png(b"hello"))
    good[-20] ^= 1
    with pytest.raises((ValueError, zlib.error, struct.error)):
        media.decode_png(bytes(good))


def test_word_hashes_follow_the_words():
    texts = [b"the  cat\tThe cat", b"", b"cat", "né x".encode()]
    words = common.Words(texts)
    assert np.diff(words.first).tolist() == [4, 0, 1, 2]
    h = words.hashes
    assert h[1] == h[3] == h[4] and h[0] != h[2]
    low = common.Words(texts, lower=True).hashes
    assert low[0] == low[2]
    again = common.Words([b"zzz", *texts]).hashes[1:]
    assert (again == h).all()


def test_wavelet_rank_and_suffix_order():
    rng = random.Random(3)
    for n, size in ((1, 2), (70, 3), (500, 40)):
        data = np.array([rng.randrange(size) for _ in range(n)])
        tree = substring.WaveletMatrix(data, size)
        for _ in range(50):
            c, at = rng.randrange(size), rng.randrange(n + 1)
            assert tree.rank(np.array([c]), np.array([at]))[0] == (data[:at] == c).sum()
    text = np.array([3, 1, 3, 1, 2, 0])
    assert substring.suffix_order(text, 6).tolist() == sorted(range(6), key=lambda i: text[i:].tolist())


def test_window_owners_against_brute_force(monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WORDS", 40)
    monkeypatch.setattr(substring, "SEARCH_WINDOWS", 15)
    rng = np.random.default_rng(5)
    segments = list({s.tobytes(): s for s in (rng.integers(0, 3, rng.integers(4, 12)).astype(np.uint64) for _ in range(60))}.values())
    owners = rng.integers(0, 100, len(segments))
    first = {}
    for s, o in zip(segments, owners, strict=True):
        for i in range(len(s) - 3):
            key = s[i : i + 4].tobytes()
            first[key] = min(first.get(key, 999), o)
    got = substring.window_owners(segments, owners, window=4)
    for s, g in zip(segments, got, strict=True):
        assert g.tolist() == [first[s[i : i + 4].tobytes()] for i in range(len(s) - 3)]


def test_matching_statistics_stop_at_the_longest_match():
    index = substring.FMIndex([np.array([1, 2, 3, 4, 5], dtype=np.uint64), np.array([9, 2, 3, 7], dtype=np.uint64)], np.array([4, 2]))
    words = np.array([8, 2, 3, 4, 9, 2, 3], dtype=np.uint64)
    length, _, _ = index.matching(words, np.arange(1, 8), 4)
    assert length.tolist() == [0, 1, 2, 3, 1, 2, 3]


def test_lexicon_automaton_is_edit_distance():
    terms = ["idiot", "moron", "cat", "worthless", "trash"]
    automaton = toxicity.LexiconAutomaton(terms)
    rng = random.Random(1)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            op = rng.randrange(3)
            if op == 0:
                word.insert(k, rng.choice("abcidmort"))
            elif word and k < len(word):
                if op == 1:
                    del word[k]
                else:
                    word[k] = rng.choice("abcidmort")
        word = "".join(word)
        near = [(levenshtein(word, t), i) for i, t in enumerate(terms) if levenshtein(word, t) <= toxicity.edits_allowed(t)]
        got = automaton.match(word)
        assert (got is None) == (not near)
        if near:
            assert got[0] == min(near)[0]


def test_quotation_lowers_the_weight():
    matcher = toxicity.Matcher(toxicity.Lexicon({"idiot": 5.0}, {}))
    plain, quoted, said = (matcher.features(t) for t in ("you idiot here", 'he used the "word idiot" here', "she said idiot to him"))
    marks, report = toxicity.FEATURES.index("marks"), toxicity.FEATURES.index("report")
    assert plain[1] > 0 and plain[marks] == plain[report] == 0
    assert quoted[marks] > 0 and quoted[report] == 0
    assert said[report] > 0 and said[marks] == 0
    score = toxicity.Model(matcher.lexicon, toxicity.PRIOR).score
    assert score(plain) > max(score(quoted), score(said))
    assert matcher.features("an idoit")[3] + matcher.features("an idiott")[3] > 0


def test_text_pieces_tokenise_like_whole_texts():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    cache, coder = tokens.PieceCache(str(public_tokenizers.path("byte_bpe_50k.json"))), ByteBPE(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(2)
    letters = list("abcdeABC  \n\t'sd1290.,!?-") + ["\x85", "\xa0", " ", "　", " ", " ", "᠎", "\x1c", "\x00", "é", "ß", "中", "😀", "²", "▁"]
    texts = ["", " ", "<|endoftext|>", "a b\nc", "a  b \n c", "x" * 3000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    flat, counts = cache.encode(pa.array(texts), 0)
    own = np.split(flat, np.cumsum(counts)[:-1])
    for text, raw, ids in zip(texts, own, coder.encode(texts), strict=True):
        assert "".join(tokens.pieces(text)) == text
        assert raw.tolist() == library.encode(text, add_special_tokens=False).ids + [0]
        assert ids == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_shingles_and_signatures():
    words = common.Words([b"A b c d e f a b c d e", b"x y", b"", b"x y z"], lower=True)
    values, counts = neardup.shingles(words)
    assert counts.tolist() == [6, 1, 0, 1]
    assert values[6] != values[7]
    signature = neardup.signatures(values, counts)
    assert signature.shape == (3, neardup.HASHES)
    same, _ = neardup.shingles(common.Words([b"a b c d e"], lower=True))
    assert same[0] in values[:6]


def test_grams_of_short_items_and_overlaps():
    grams = decontaminate.GramSet([("long", b"a b c d e"), ("short", b"x y"), ("none", b"...")], window=3)
    docs = [decontaminate.words_of(t) for t in (b"q A, b c d z", b"x", b"x y x y", b"")]
    found = grams.scan(docs)
    assert sorted(found) == [0, 2]
    assert found[0][1] == {"long"} and decontaminate._covered(6, found[0][0]).tolist() == [False, True, True, True, True, False]
    assert found[2][1] == {"short"} and decontaminate._covered(4, found[2][0]).all()


def test_base_findings():
    text = "password=abcdefgh token=short API-KEY: x apikey : 'ABCD1234+' AKIA" + "A" * 12 + " " + "0f" * 16 + " ſecret=abcdefghij token=secret:abcdefghij"
    got = [(k, text[a:b]) for k, a, b in secret_scan.base_findings(text)]
    assert got == [("assign", "password=abcdefgh"), ("assign", "apikey : 'ABCD1234+"), ("access", "AKIA" + "A" * 12), ("hex", "0f" * 16)]


def test_network_learns_and_keeps_recall():
    rng = random.Random(4)
    hexa = ["key=" + "".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(200)]
    words = ["number " + "".join(rng.choice("0123456789") for _ in range(10)) for _ in range(200)]
    codes = np.array([secret_scan.encode(t, t.index("=" if "=" in t else " ") + 1, len(t)) for t in hexa + words])
    y = np.array([1] * 200 + [0] * 200)
    network = secret_scan.CharCNN()
    network.train(codes[::2], y[::2])
    z = network.logits(codes[1::2])
    assert ((z > 0) == (y[1::2] == 1)).mean() > 0.95


def test_token_files_come_by_number(spark):
    names = [f"part-{n:05d}-abc.c000.parquet" for n in (2, 99_999, 100_000, 100_001, 10)]
    rows = spark.createDataFrame([(n, f"part-{n}") for n in names], "file string, other string")
    assert [r.file for r in rows.orderBy(tokens.file_number(F.col("file"))).collect()] == [names[k] for k in (0, 4, 1, 2, 3)]


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontaminate_with_clashing_names(spark, monkeypatch, blocks):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words[:20]), "x", [9], "y"), (2, " ".join(words[30:]), "x", None, None), (3, None, None, [], "")], "doc_id long, body string, __text string, __ranges array<int>, __items string")
    items = spark.createDataFrame([(7, " ".join(words[2:16])), (8, "other words here"), (9, "more of them")], "item_id long, text string")
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    kept = ["doc_id", "__text", "__ranges", "__items"]
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items, kept, text_column="body").collect()}
    assert [(got[k].n_hit, got[k].contaminated, got[k]["__text"], got[k]["__ranges"], got[k]["__items"]) for k in (1, 2, 3)] == [(14, True, "x", [9], "y"), (0, False, "x", None, None), (0, False, None, [], "")]
    left = decontaminate.decontaminate(docs, items, text_column="body")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    cut = {r.doc_id: r.body for r in decontaminate.decontaminate(docs, items, mode="spans", text_column="body").collect()}
    assert cut[1].split() == words[:2] + words[16:20] and cut[3] is None
    assert decontaminate.contamination(docs.limit(0), items, kept, text_column="body").count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0), text_column="body").count() == 3
