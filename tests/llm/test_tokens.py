"""Packing, token files and the SentencePiece codec against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import byte_bpe, memo, packing, piece_bpe, sentencepiece_codec, token_files

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "9", "'s", ".", ",", "\u0085", "\x1c", "<|endoftext|>", "<0x0A>", "</s>", "▁", "漢", "ſ", "İ", "👩", "the", "don't", "ing", "̀", "²", "\r\n", "_", "$$$", "   ", "!!", "\x00"]


def texts(n, seed=0, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]


def frame(spark, values, ids=None):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids or range(len(values)), values)], "doc_id long, text string, id string, start int")


def test_byte_bpe():
    library, own = Tokenizer.from_file(BYTE), byte_bpe.load(BYTE)
    assert own.by_piece
    for t in texts(4000):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_piece_bpe():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_bpe.load(PIECE)
    for t in texts(4000, 1):
        ids = own.encode(t)
        assert ids == library.encode(t), t
        assert own.decode(ids) == library.decode(ids), t
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(270)]) for _ in range(rng.randrange(7))]
        assert own.decode(ids) == library.decode(ids), ids


def test_memo_forgets_but_stays_right():
    m = memo.Memo(lambda k: k * 2, 200_000)
    rng = random.Random(0)
    for _ in range(20_000):
        k = rng.randrange(5000)
        assert m[k] == 2 * k and len(m) <= 1300 and len(m.old) <= 1300


def test_round_trip(spark):
    values = [*texts(200, 3, 40), None, "", "long " * 20_000]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r["doc_id"]: r for r in sentencepiece_codec.round_trip(frame(spark, values), PIECE).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        ids = library.encode(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
    encoded = sentencepiece_codec.encode(frame(spark, values), PIECE)
    assert {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(encoded, PIECE).collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(values)}
    assert sentencepiece_codec.round_trip(frame(spark, []), PIECE).count() == 0


def test_best_cuts_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 9)
        pos = sorted(rng.sample(range(1, 200), n))
        at = np.array([0, *pos])
        gaps = np.diff(at)
        if gaps.max() > 128:
            continue
        pen = np.array([0.0, *[rng.choice([0.0, 2.0, 6.0]) for _ in pos]])

        def cost(ends):
            total, begin = 0.0, 0
            for e in ends:
                size = e - begin
                if size > 128:
                    return float("inf")
                power = size & (size - 1) == 0 and size >= packing.LEAST_POWER
                total += (0 if power else 128 - size) + pen[list(at).index(e)] + packing.EACH
                begin = e
            return total

        best = min(cost([p for k, p in enumerate(pos[:-1]) if mask >> k & 1] + [pos[-1]]) for mask in range(1 << (n - 1)))
        assert cost(packing.best_cuts(at, pen, 128)) == pytest.approx(best)


def test_pack(spark):
    rng = random.Random(6)
    values = [" ".join(rng.choice(["the", "cat", "sat.", "on", "mats,", "Ünder"]) for _ in range(rng.randrange(700))) for _ in range(60)] + [None, "", "word " * 9000]
    library = Tokenizer.from_file(BYTE)
    got = packing.pack(frame(spark, values), BYTE, length=256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(values):
        ids, pieces = [*library.encode(t or "", add_special_tokens=False).ids, 1], sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == np.array(ids, "<u4").tobytes()
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()] and {r["doc_tokens"] for r in pieces} == {len(ids)}
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()]
        size = sum(r["length"] for r in pieces)
        assert size <= 256
        padding, total = padding + (256 - size if size & (size - 1) else 0), total + size
    assert padding < 0.05 * total
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_token_files(spark, tmp_path):
    values, ids = [*texts(300, 8, 60), None, "", "tail " * 5000], None
    ids = list(range(len(values)))
    random.Random(1).shuffle(ids)
    library = Tokenizer.from_file(BYTE)
    files = token_files.write_token_files(frame(spark, values, ids), BYTE, out=str(tmp_path / "out"), end_id=0, length=64)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(files, "bigint").collect()}
    start, stream = 0, []
    for i, t in sorted(zip(ids, values)):
        tokens = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start, stream = start + len(tokens), stream + tokens
    seen = []
    for f in sorted(files.collect(), key=lambda r: r["part"]):
        file = token_files.TokenFile(f["file"])
        assert len(file) == f["n_sequences"] and all(b.schema.field("ids").type.list_size == 64 for b in file.batches)
        for i in range(len(file)):
            tokens, mask = file.sequence(i)
            assert len(tokens) == 64 and not tokens.flags.owndata
            seen += tokens[mask].tolist()
    assert seen == stream
    empty = token_files.write_token_files(frame(spark, []), BYTE, out=str(tmp_path / "none"))
    assert token_files.read_token_files(empty, "bigint").count() == 0


def test_texts_together_as_alone(monkeypatch):
    """encode_all gives what encode and the library give, whatever the arena forgets."""
    from factloom.llm import byte_bpe

    coder = byte_bpe.ByteBPE(BYTE)
    library = Tokenizer.from_file(BYTE)
    values = [*texts(300, 5, 60), "", " ", "  ", " a", "a ", "a  b", "\n a", "x" * 5000, "é ü " * 500]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in values]
    assert coder.encode_all([t.encode() for t in values]) == want
    monkeypatch.setattr(byte_bpe, "MOST_IDS", 100)
    for k in range(0, len(values), 7):
        assert coder.encode_all([t.encode() for t in values[k : k + 7]]) == want[k : k + 7]
    assert coder.encode_all([]) == []


def test_encoding_does_not_copy_the_arena():
    """The ids of known pieces are read where they are: with 4,000,000 kept ids a short text takes under 4 MB more."""
    import tracemalloc

    import numpy as np
    import public_tokenizers

    from factloom.llm import byte_bpe

    encoder = byte_bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [b"some words here", b"other words", b""]
    before = encoder.encode_all(texts)
    encoder.arena = np.concatenate([encoder.arena[: encoder.used], np.zeros(4_100_000, "<u4")])
    encoder.used += 4_000_000
    tracemalloc.start()
    again = encoder.encode_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again == before == [encoder.encode(x.decode()) for x in texts] and peak < 4 << 20
