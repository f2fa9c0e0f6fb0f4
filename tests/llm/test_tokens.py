import zlib
from collections import defaultdict

import numpy as np
import pytest

from sondage.llm import queries
from sondage.llm.packing import RoomTree, pack_documents, plan_best_fit
from sondage.llm.queries import _tokenizer
from sondage.llm.token_output import Codebook, code_lengths, decode_bits, encode_bits, round_trip
from sondage.llm.tokens import PieceEncoder

from .conftest import TEXTS


def plain(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_tokenizer(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize(("name", "style"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
@pytest.mark.parametrize("most", [0, 7, 100_000])
def test_cached_pieces_give_the_ids_of_whole_texts(name, style, most):
    texts = [t for _, t in TEXTS] + ["it's  we'll\x1c x \x85 y", " lead", "trail ", "\u2028 a", "ΑΣ ΑΣ. s\u0327 \u0327x", "<|endoftext|> a<|endoftext|>", "<|ENDOFTEXT|> a <|startoftext|>x"]
    e = PieceEncoder(_tokenizer(name), style, most)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
        assert got == plain(name, texts)


def best_fit(lengths, width):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(width - n)
    return sorted(rooms)


def test_the_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for width in (10, 37, 100):
        for _ in range(20):
            lengths = rng.integers(1, width + 1, rng.integers(1, 300)).tolist()
            counts = {n: lengths.count(n) for n in set(lengths)}
            used, ranks = defaultdict(list), defaultdict(list)
            for length, rank, first, n, each, offset in plan_best_fit(counts, width).tolist():
                ranks[length] += range(rank, rank + n * each)
                for k in range(n * each):
                    used[first + k // each].append((offset + k % each * length, length))
            for n, c in counts.items():
                assert sorted(ranks[n]) == list(range(c))
            rooms = []
            for spans in used.values():
                at = 0
                for offset, length in sorted(spans):
                    assert offset == at
                    at += length
                rooms.append(width - at)
            assert sorted(rooms) == best_fit(lengths, width)


def test_room_tree():
    t = RoomTree(9)
    for open_rooms in ({3, 7}, {0, 9}, set()):
        for r in range(10):
            t.set(r, r in open_rooms)
        for n in range(10):
            assert t.tightest(n) == min((r for r in open_rooms if r >= n), default=None)


def test_packing_of_documents(docs, no_docs):
    rows = pack_documents(docs, _tokenizer("word_bpe_49k.json"), keep_ids=True).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 2048
    for (i, _), ids in zip(TEXTS, plain("word_bpe_49k.json", [t for _, t in TEXTS]), strict=True):
        copies = sum(1 for k, _ in TEXTS if k == i)
        starts = sorted(r.start for r in by_id[i])
        assert starts == sorted(list(range(0, len(ids) + 1, 2048)) * copies)
        if copies == 1:
            assert b"".join(r.ids for r in sorted(by_id[i], key=lambda r: r.piece)) == np.array([*ids, 0], "<u4").tobytes()
    assert pack_documents(no_docs, _tokenizer("word_bpe_49k.json")).count() == 0


def test_sequences_of_the_given_documents(spark):
    """The query's rows as a whole: every document's ids, cut into pieces, lie without gaps in as few sequences as best-fit decreasing needs."""
    d = "/root/testdata/sf0.001"
    rows = queries.op2_best_fit_packing(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    want = {}
    for i, ids in zip(texts, plain("word_bpe_49k.json", texts.values()), strict=True):
        raw = np.array([*ids, 0], "<u4")
        for k, at in enumerate(range(0, len(raw), 2048)):
            want[i, k] = (at, len(raw[at : at + 2048]), zlib.crc32(raw[at : at + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    rooms = []
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        rooms.append(2048 - at)
    assert sorted(rooms) == best_fit([r.length for r in rows], 2048)


def test_packing_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, None), (3, "x " * 5000), (3, "x " * 5000), (4, "")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), _tokenizer("word_bpe_49k.json")).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == sorted([("None", 4), ("None", 4), ("None", 1), ("3", 2048), ("3", 2048), ("3", 905), ("3", 2048), ("3", 2048), ("3", 905), ("4", 1)])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) == max(a + n for a, n in x) <= 2048 and len({a for a, _ in x}) == len(x) for x in bins.values())


def test_code_lengths_are_limited_and_prefix_free():
    counts = np.array([0, 1, 1, 2, 4, 8, 16, 32, 64, 128, 0, 256])
    free, short = code_lengths(counts, 20), code_lengths(counts, 5)
    assert free.max() == 9 and short.max() == 5
    for n in (free, short):
        assert sum(2.0 ** -int(x) for x in n if x) <= 1
    assert (counts * short).sum() >= (counts * free).sum()
    assert code_lengths(np.array([0, 7]), 3).tolist() == [0, 1] and code_lengths(np.zeros(3, int), 3).tolist() == [0, 0, 0]


def test_blocks_decode_to_what_was_encoded():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.02, 5000) - 1, 299)
    book = Codebook(code_lengths(np.bincount(ids, minlength=300), 12))
    parts = [ids[:1], ids[1:1000], ids[1000:]]
    blocks = [(*encode_bits(p, book, book.codes(), 64), len(p)) for p in parts]
    for got, want in zip(decode_bits(blocks, book.table(), book.width, 64), parts, strict=True):
        assert got.tolist() == want.tolist()


def test_token_files_round_trip(docs, no_docs):
    rows = sorted(round_trip(docs, _tokenizer("byte_bpe_50k.json"), block_ids=500).collect(), key=lambda r: r.start)
    start = 0
    for r, ((i, _), ids) in zip(rows, zip(TEXTS, plain("byte_bpe_50k.json", [t for _, t in TEXTS]), strict=True), strict=True):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1
    assert round_trip(no_docs, _tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("options", [{"stride": 64}, {"stride": 1000, "vocabulary": 70_000, "block_ids": 3000}])
def test_files_name_their_stride_and_vocabulary(docs, options):
    want = sorted(tuple(r) for r in round_trip(docs, _tokenizer("byte_bpe_50k.json")).collect())
    assert sorted(tuple(r) for r in round_trip(docs, _tokenizer("byte_bpe_50k.json"), **options).collect()) == want


def test_query_on_the_given_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, []
    for (i, _), ids in zip(texts, plain("byte_bpe_50k.json", [t for _, t in texts]), strict=True):
        want.append((i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_ids(spark, d).collect()) == want


def test_token_files_of_null_and_repeated_ids(spark):
    rows = [(None, f"t{k % 3}") for k in range(9)] + [(1, "a"), (1, "b"), (1, "a"), (2, None)]
    got = sorted(round_trip(spark.createDataFrame(rows, "doc_id long, text string"), _tokenizer("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 9 + [1, 1, 1, 2]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert len({r.ids_crc32 for r in got[:9]}) == 3 and len({r.ids_crc32 for r in got[9:12]}) == 2


def test_byte_level_pieces_are_kept_in_more_spellings():
    from sondage.llm.tokens import encoder

    assert encoder(_tokenizer("byte_bpe_50k.json"), "bytes").most >= 1_000_000
    assert encoder(_tokenizer("word_bpe_49k.json"), "words").most == 400_000
