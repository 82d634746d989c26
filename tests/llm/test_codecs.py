import hashlib
import random
import zlib

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from fieldlens.llm import packing, sentencepiece_codec
from fieldlens.llm.sentencepiece_codec import Codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a" * 3000, "ab" * 1500, "the" * 900, " " * 300, "x" + " " * 50 + "y", "<s> </s> <unk>", "▁a ▁ b", "\x00\x01", "日本語のテキスト", "🙂🙂 é ß"]


def random_texts(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encoding_and_decoding_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), Codec.load(MODEL)
    texts = ODD + random_texts("aab  \n\t▁é日<s>0123xthe .,🙂", 1500, 3) + random_texts(["the ", "ing", "er", "tion", "aaa", " a", "ab", "b"], 500, 4)
    expected = library.encode(texts)
    assert [ids.tolist() for ids in own.encode(texts)] == expected
    assert [own.decode(ids) for ids in expected] == [library.decode(ids) for ids in expected]


def test_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(None, "null id"), (1, None), *((i + 2, t) for i, t in enumerate(ODD))]
    got = {r[0]: tuple(r)[1:] for r in sentencepiece_codec.encode_digests(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in rows:
        ids = library.encode(text or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert sentencepiece_codec.encode_digests(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_token_ids_equal_the_library():
    library, own = Tokenizer.from_file(VOCABULARY), packing.Encoder.load(VOCABULARY)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "é", "<|endoftext|>", "<|end", "1", "日", "!", "🙂", "\t", "\r\n", "'LL", "\xa0", "\x1c", "\u3000"]
    texts = ODD + random_texts(alphabet, 2000, 1)
    rng = random.Random(5)
    texts += ["".join(rng.choice(alphabet) * rng.choice([1, 1, 2, 600, 1100, 5000]) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.encode(t).tolist() for t in texts] == expected
    sliced = packing.Encoder(VOCABULARY, slice_chars=5)
    assert [sliced.encode(t).tolist() for t in texts[:2000]] == expected[:2000]


def test_token_ids_of_every_character_equal_the_library():
    library, own = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY, slice_chars=3)
    rng = random.Random(9)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF][::7]
    rng.shuffle(every)
    for i in range(0, len(every), 2000):
        text = "".join(rng.choice(["a", "! ", " ", "1"]) + c + rng.choice(["", " ", " b", "\n"]) for c in every[i : i + 2000])
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_runs_of_one_character():
    library, own = Tokenizer.from_file(VOCABULARY), packing.Encoder.load(VOCABULARY)
    for run in (" ", "\n", "\t", "a", "1"):
        text = "x" + run * 1_000_000 + "y"
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.encode(" " * 10_000_000)) == 10_000_000 and len(own.encode("a" * 10_000_000)) == 2_500_000


def test_plan_uses_each_length_as_often_as_it_occurs():
    rng = random.Random(2)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(rng.randint(0, 30))}
        patterns = packing.plan(counts, 64)
        used = {}
        for lengths, times in patterns:
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts
    assert sum(p.times for p in packing.plan({60: 5, 4: 5, 30: 2, 20: 2, 10: 2, 3: 2, 1: 2}, 64)) == 7  # exact single, pair and triple complements


def test_packing(spark):
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([0, 5, 40, 300, 1023, 1024, 3000])))) for i in range(60)]
    rows += [(100, None), (None, "no id"), (3, rows[3][1])]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()
    pieces = {}
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) - (len(ids) - 1) // 1024 * 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[i, k] = (a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 1024) * 1.1 + 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_packing_of_long_repeated_and_oddly_named_rows(spark):
    long = " word" * 2_000_000
    rows = [(1, long, 7, 7), (2, "same", 7, 7), (2, "same", 7, 7), (3, "same", 7, 7)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece int, number long"), VOCABULARY).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2_000_001
    assert len([r for r in got if r["doc_id"] == 2]) == 2 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
