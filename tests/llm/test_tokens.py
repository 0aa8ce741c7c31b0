import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillstone.llm import byte_bpe, packing, token_counts

RANKS, JSON, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(seed, n):
    rnd = random.Random(seed)
    pools = ["abc 's\n\t _!²½Ⅷ\x85\xa0\x1ć​", "ΣσİǅA<|endoftext|>", "éèß漢字かな한글😀🇫🇷 ", None]
    for _ in range(n):
        pool = rnd.choice(pools)
        yield "".join(rnd.choice(pool) if pool else chr(rnd.choice([rnd.randint(0, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(rnd.randint(0, 40)))


def test_byte_codec_equals_library_and_round_trips(reference):
    codec = byte_bpe.codec_from_ranks(RANKS, P.PATTERN)
    for text in [*noise(1, 3000), "x" * 5000, "word " * 100_000]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_offsets_and_split_characters():
    codec = byte_bpe.codec_from_ranks(RANKS, P.PATTERN)
    ids = codec.encode("a漢😀b")
    spans = codec.offsets(ids, "a漢😀b")
    assert spans[0] == (0, 1) and spans[-1] == (3, 4) and {s for s in spans[1:-1]} == {(1, 2), (2, 3)}
    assert byte_bpe.decode_text(codec.decode(ids[:8])).startswith("a") and "�" in byte_bpe.decode_text(codec.decode(ids[:8]))


def test_json_codecs_equal_library():
    library = Tokenizer.from_file(JSON)
    slow, fast = byte_bpe.codec_from_json(JSON), packing.fast_codec(JSON)
    for text in noise(2, 2000):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(slow.encode(text), "<u4").tolist() == want == np.frombuffer(fast.encode(text), "<u4").tolist()


def test_counts_equal_library(texts):
    library, counter = Tokenizer.from_file(WORDS), token_counts.Counter(WORDS)
    for text in [*noise(3, 3000), *texts.values()]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("odd", ["\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u180e", "\u200b", "'", "\r", "\t"])
def test_long_texts_are_cut_where_the_libraries_part(reference, odd):
    """Every place near the piece's end, next to characters that libraries take for white space or not."""
    words, counter, codec = Tokenizer.from_file(WORDS), token_counts.Counter(WORDS), byte_bpe.codec_from_ranks(RANKS, P.PATTERN)
    for tail in (f"---{odd}= end of it", f"b{odd} c d", f"{odd}s {odd} {odd}{odd}x y", f"a{odd}\n{odd} b 12{odd}3 z"):
        text = ("ab " * 90_000)[: byte_bpe.PIECE_CHARS - 1] + tail * 3
        assert counter.count(text) == len(words.encode(text, add_special_tokens=False).ids)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_merges_by_id_are_proven_of_the_file():
    assert packing.merges_by_id(byte_bpe.codec_from_json(JSON)) and packing.fast_codec(JSON).proven


def test_whole_tokens_are_proven():
    library, counter = Tokenizer.from_file(WORDS), token_counts.Counter(WORDS)
    for word in sorted(counter.whole)[::500]:
        assert counter._merged(word) == 1
    assert "the" in counter.whole and len(library.encode("the", add_special_tokens=False).ids) == 1


def test_token_count_cases(spark, awkward):
    rows = token_counts.token_counts(awkward, WORDS).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and got[1].n_tokens == got[2].n_tokens == got[1].n_bytes == 0 and got[5].over_limit and not got[4].over_limit
    assert token_counts.token_counts(awkward.limit(0), WORDS).count() == 0


def test_round_trip_digests(spark, awkward, reference):
    rows = byte_bpe.round_trip_digests(awkward, RANKS, P.PATTERN).collect()
    sources = {r.doc_id: r.text for r in awkward.collect()}
    for r in rows:
        text = sources[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    encoded = byte_bpe.encode(awkward, RANKS, P.PATTERN, offsets=True)
    assert {r.doc_id: r.text for r in byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()} == {k: v or "" for k, v in sources.items()}


def packed_well(rows, sources, library, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in sources.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:]) and (len(own) == 1) == (len(ids) <= capacity)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= capacity
    return len(by_sequence)


def test_packing(spark, docs, texts):
    library = Tokenizer.from_file(JSON)
    rows = packing.pack(docs, JSON, 512, small=64).collect()
    used = packed_well(rows, texts, library, 512)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 512) + 1


def test_packing_with_production_parameters(spark):
    library = Tokenizer.from_file(JSON)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, JSON).collect()
    used = packed_well(rows, {r.doc_id: r.text for r in docs.collect()}, library, 2048)
    assert used <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_cases(spark, awkward):
    library = Tokenizer.from_file(JSON)
    once = awkward.dropDuplicates(["doc_id"])
    packed_well(packing.pack(once, JSON).collect(), {r.doc_id: r.text for r in once.collect()}, library, 2048)
    rows = packing.pack(awkward, JSON).collect()
    assert len([r for r in rows if r.doc_id == 4]) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(awkward.limit(0), JSON).count() == 0


@pytest.mark.parametrize("histogram", [{}, {2048: 5}, {1: 1}, {1025: 7}, {700: 3, 648: 9, 100: 50}, {n: n % 7 for n in range(1, 2049)}])
def test_plans_place_everything_once(histogram):
    runs, bins = packing.plan(dict(histogram), 2048)
    ranks, room = defaultdict(set), defaultdict(list)
    for length, first, n, bin_, offset in runs:
        for k in range(n):
            assert first + k not in ranks[length]
            ranks[length].add(first + k)
            room[bin_ + k].append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == {k: n for k, n in histogram.items() if n}
    assert len(room) <= bins
    for own in room.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
