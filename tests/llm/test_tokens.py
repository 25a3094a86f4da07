"""Pair-index BPE, alignment of two tokenizers and ranked search against the libraries and brute force."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quilate.llm import alignment, pair_bpe, queries, search

SCHEMA = "doc_id bigint, text string, ids string, score string"
A, B, PATTERN = queries.BYTE_BPE, queries.PIECES, public_tokenizers.PATTERN
BLOCKS = [(32, 128), (0, 0x250), (0x2000, 0x2070), (0x370, 0x530), (0x4E00, 0x4F00), (0x1F600, 0x1F650), (0xAC00, 0xAD00), (0x2570, 0x25B0), (0x1680, 0x1690)]


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    texts = [None, "", " ", "  ", "foo ", " foo", "a▁b c", "<s> <|endoftext|> x<|endoftext|></s><unk>", "\x00 a", "w" * 3000, "aaaaaaab" * 900, " \n \t x", "the the cat sat " * 400, "same", "same", "é ü  ß\n\n x\x1c y\x85 z"]
    for _ in range(300):
        n, block = r.randint(1, 40), r.choice(BLOCKS)
        texts.append("".join(r.choice([" ", "  ", " \n", "\n\n", " a", " the", "ing", "é", "12", "\x85 "]) if r.random() < 0.6 else chr(r.randrange(*block)) for _ in range(n)))
    return [*enumerate(texts), (None, "no id"), (7, "the id of another")]


# byte-pair encoding


def test_pair_index_equals_the_library(spark, rows):
    library = Tokenizer.from_file(A)
    want = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert text == (t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = pair_bpe.digests(documents(spark, rows), A, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_ids_and_texts_come_back(spark, rows):
    coded = pair_bpe.encode(documents(spark, rows), A, PATTERN)
    assert coded.columns == ["doc_id", "score", "ids"]  # the column that was named like the result is replaced
    back = pair_bpe.decode(coded, A)
    assert Counter((x.doc_id, x.text) for x in back.collect()) == Counter((d, t or "") for d, t in rows)
    odd = spark.createDataFrame([([163, 50256],), (None,), ([],)], "ids array<int>")
    library = Tokenizer.from_file(A)
    assert [x.text for x in pair_bpe.decode(odd, A).collect()] == [library.decode([163, 50256], skip_special_tokens=False), "", ""]


def test_ranks_apply_alike_one_by_one_and_at_once(monkeypatch):
    vocabulary, r = pair_bpe.Vocabulary(A), random.Random(2)
    pieces = [("".join(r.choice("abcdeoinst") for _ in range(r.randint(1, 30)))).encode() for _ in range(3000)] + [b"", b"a" * 5000, b"ab" * 5000]
    found = []
    for many in (2, 10**9):
        monkeypatch.setattr(pair_bpe, "MANY", many)
        found.append([x.tolist() for x in vocabulary.encode_together(pieces)])
    library = Tokenizer.from_file(A)
    assert found[0] == found[1] == [x.ids for x in library.encode_batch([p.decode() for p in pieces])]
    assert vocabulary.encode_together([]) == []


def test_memory_of_chunks_is_bounded(rows):
    encoder = pair_bpe.Encoder(A, PATTERN, indexed=64)
    texts = pair_bpe.Texts(encoder.encoded, {}, remembered=50)
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    for (_, t), ids in zip(rows, texts.of([t for _, t in rows], block=100), strict=True):
        assert np.frombuffer(b"".join(ids), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids
    assert len(texts.memo) <= 2000


def test_only_plain_vocabularies_are_read():
    with pytest.raises(ValueError):
        pair_bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# alignment


def aligned(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    of_a, of_b = pair_bpe.Vocabulary(A).bytes_of, alignment.Pieces(B).bytes_of
    found, counts, best = [], Counter(), defaultdict(int)
    for d, t in rows:
        whole = (" " + (t or "")).encode()
        a, b = (first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)) if t else ([], [])
        if not t or b"".join(of_a[i] for i in a) != whole or b"".join(of_b[i] for i in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(of[i]) for i in ids]).astype(int).tolist() for of, ids in ((of_a, a), (of_b, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([i for i, e in zip(a, ends[0], strict=True) if low < e <= high], [i for i, e in zip(b, ends[1], strict=True) if low < e <= high]) for low, high in zip([0, *cuts], cuts)]
        found.append((d, a, b, groups))
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = Counter()
    for d, a, b, groups in found:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out[d, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


@pytest.mark.parametrize("block, held", [(50, 30), (1 << 20, 1 << 19)])
def test_alignment_matches_brute_force(spark, rows, block, held):
    short = [(d, t[:600] if t else t) for d, t in rows] + [(9000, "中文字符测试文本" * 60 + "🙂🙃" * 40)]
    got = alignment.alignments(documents(spark, short), A, PATTERN, B, block=block, held=held)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == aligned(short)


def test_spans_end_where_both_end():
    ends = lambda tokens: np.cumsum([len(t) for t in tokens])
    first, second = alignment.spans(ends([b" ab", b"c", b" d", b"\n"]), ends([b" a", b"bc", b" ", b"d", b"\n"]), 7)
    assert first.tolist() == [2, 3, 4] and second.tolist() == [2, 4, 5]


# ranked search


def ranks(docs, items, k=20):
    of = lambda t: re.findall(search.TERM, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = [(d, Counter(of(t))) for d, t in docs]
    some, every = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = Counter()
    for i, text in dict.fromkeys(items):
        scores = []
        for d, c in own:
            m = 75 + (25 * sum(c.values()) * some) // max(1, every)
            scores.append((sum(n * math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, n in Counter(of(text)).items() if c[t]), d))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out.update((i, r + 1, d, s) for r, (s, d) in enumerate(best))
    return out


@pytest.mark.parametrize("documents_per_shard, tiers", [(7, ((1, 0.0), (2, 0.3))), (64, ((2, 0.05),)), (4096, search.TIERS)])
def test_search_matches_brute_force(spark, documents_per_shard, tiers):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    text = lambda n: " ".join(x.title() if r.random() < 0.2 else x for x in r.choices(vocabulary, weights, k=n))
    docs = [(i, text(r.randint(1, 60))) for i in range(300)] + [(1000 + i, "copy of a copy, copy") for i in range(40)]
    docs += [(400, None), (401, ""), (402, "-- !!"), (None, "copy of a copy, copy"), (5, "copy again"), (403, text(5000)), (404, "中文 copy_of\u0085x")]
    items = [(i, text(12)) for i in range(20)] + [(50, "Copy COPY of"), (50, "Copy COPY of"), (50, "other abc"), (51, None), (52, "nowhere zzzz"), (53, "")]
    got = search.ranked(documents(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int"), documents=documents_per_shard, tiers=tiers)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranks(docs, items)


def test_proven_items_read_no_lower_tier(spark, monkeypatch):
    asked, plain = [], search._level

    def level(shards, pairs, tier, k):
        asked.append((tier, pairs.select(F.explode("items")).count()))
        return plain(shards, pairs, tier, k)

    monkeypatch.setattr(search, "_level", level)
    docs = [(i, f"common word{i} " + "common " * (i % 7)) for i in range(120)]
    items = [(1, "word7 word8"), (2, "common")]
    got = search.ranked(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), documents=20, tiers=((1, 0.0), (5, 0.2)))
    assert Counter(map(tuple, got.collect())) == ranks(docs, items)
    # rare terms lie in the first tier whole, so the first item is proven there in every shard
    assert [t for t, _ in asked] == [0, 1, 2] and all(n <= asked[0][1] // 2 for _, n in asked[1:])


def test_empty_tables(spark):
    empty, items = documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert pair_bpe.digests(empty, A, PATTERN).count() == 0
    assert alignment.alignments(empty, A, PATTERN, B).count() == 0
    assert search.ranked(empty, items).count() == 0
    assert search.ranked(documents(spark, [(1, "a")]), items.limit(0)).count() == 0


def test_index_in_files_of_few_shards(spark):
    docs = documents(spark, [(i, f"term{i} common") for i in range(60)]).coalesce(1)
    counted = search.totals(docs)
    shards = search.stored(search.index(docs, counted, documents=2))
    held = shards.groupBy(F.input_file_name()).count().select("count").collect()
    assert sum(r["count"] for r in held) == 30 and max(r["count"] for r in held) <= search.SHARDS


def test_memory_of_a_shard():
    draw, own = np.random.default_rng(1), search._Shard()
    words = [f"w{i}" for i in range(20_000)]
    for k in range(1000):
        own.add(k, " ".join(words[i] for i in draw.integers(0, len(words), 1000)))
    tracemalloc.start()
    own.row(0, (1000, 1_000_000), search.TIERS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 72 * own.held
