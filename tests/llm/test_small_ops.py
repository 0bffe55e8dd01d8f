"""Exact dedup, mixing, token counts and packing against plain Python on small and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from songloom.llm.exact_dedup import _keyed, build_index, exact_groups, without_copies
from songloom.llm.mixing import flight, mixed_documents, taken_words
from songloom.llm.packing import fullest, pack, plan, sequences
from songloom.llm.queries import tokenizer_path
from songloom.llm.tokens import count_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"
ODD = [
    (1, "Hello  world\n\nx ", "en", "a", 1, "k", 1),
    (2, "hello  World\n\nX ", "en", None, 1, "k", 1),
    (2, "hello  World\n\nX ", "en", None, 1, "k", 1),
    (3, None, None, "b", None, None, None),
    (4, "", "en", "b", 0, "k", 1),
    (None, "É é it's <|endoftext|> don't stop", "fr", "a", 1, "k", 1),
    (5, "É é it's <|endoftext|> don't stop", "fr", "ä", 1, "k", 1),
    (6, "\t\n ", "en", "a", 1, "k", 1),
    (7, " ".join(f"word{i}" for i in range(3000)), "en", "Z", 1, "k", 1),
    (8, "x" * 9000, "en", "Z", 1, "k", 1),
    (9, "a　b  <|startoftext|>c é ́x 12345 ... '''s", "en", "Z", 1, "k", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("bits", [62, 6, 0])
def test_exact_groups(spark, odd, small, bits):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        rows = [(r.doc_id, lowered(r.text)) for r in docs.collect()]
        groups = defaultdict(list)
        for doc, text in rows:
            groups[text].append(doc)
        keep = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
        got = exact_groups(docs, bucket_entries=20, address_bits=bits).collect()
        want = Counter((d, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
        left = without_copies(docs, bucket_entries=20, address_bits=bits)
        assert left.columns == docs.columns
        assert sorted(map(str, ((r.doc_id, lowered(r.text)) for r in left.collect()))) == sorted(map(str, ((keep[t], t) for t in groups)))


def test_texts_that_collide_form_chains(spark, odd):
    """All texts at one address: they are told apart by their bytes, and by nothing else."""
    _, index = build_index(_keyed(odd, "doc_id", "text", 0), 2)
    chain = index.collect()
    texts = Counter(lowered(r.text) for r in odd.collect())
    assert {r._address for r in chain} == {0} and {r._chained: r.group_size for r in chain} == texts
    _, clean = build_index(_keyed(odd, "doc_id", "text", 62), 2)
    single = clean.collect()
    assert all(r._chained is None for r in single) and len(single) == len(texts)
    assert sorted(r.text_sha256 for r in single) == sorted(r.text_sha256 for r in chain)


def test_directory_splits_overfull_buckets_only(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    _, index = build_index(_keyed(docs, "doc_id", "text", 62), 20)
    filled = Counter(r._bucket for r in index.collect())
    assert len(filled) > 4 and max(filled.values()) <= 20
    assert sum(filled.values()) == len({lowered(r.text) for r in docs.collect()})


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert exact_groups(none).count() == 0 and without_copies(none).count() == 0
    assert taken_words(none, (3, 1, 2)).count() == 0 and mixed_documents(none, (3, 1, 2)).count() == 0
    assert count_tokens(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert pack(none, tokenizer_path("byte_bpe_50k.json")).count() == 0


def targets_of(rows):
    sizes = defaultdict(int)
    for source, size in rows:
        sizes[source] += size
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    full: dict = {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return sizes, full | {s: weight[s] * level for s in open_}
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark, odd, small):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        words = lambda t: len((t or "").encode().split())
        rows = [(r.source, words(r.text)) for r in docs.collect()]
        sizes, targets = targets_of(rows)
        got = taken_words(docs, (3, 1, 2)).collect()
        assert sorted(map(str, ((r.doc_id, r.size) for r in got))) == sorted(map(str, ((r.doc_id, words(r.text)) for r in docs.collect())))
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
            assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        for s in sizes:
            assert abs(taken[s] - targets[s]) <= largest[s]
        again = taken_words(docs.repartition(3), (3, 1, 2)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        mixed = mixed_documents(docs, (3, 1, 2))
        assert mixed.columns == docs.columns
        assert Counter(str(r.doc_id) for r in mixed.collect() if words(r.text)) == Counter(
            str(r.doc_id) for r in got for _ in range(r.copies) if r.size
        )


def test_flight_keeps_the_balance():
    import numpy as np

    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 400), np.full(400, 0.37)
    size[100:200] = 7
    after = flight(size, p, rng.random(401))
    open_ = (after > 1e-9) & (after < 1 - 1e-9)
    assert open_.sum() <= 2
    assert after.sum() == pytest.approx(p.sum()) and (after * size).sum() == pytest.approx((p * size).sum())


def test_token_counts(spark, odd, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        want = Counter()
        for r in docs.collect():
            n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
            want[(r.doc_id, len((r.text or "").encode()), n, n > 2048)] += 1
        got = Counter(map(tuple, count_tokens(docs, tokenizer_path("word_bpe_49k.json")).collect()))
        assert got == want


def test_packing(spark, odd, small):
    from tokenizers import Tokenizer

    import numpy as np

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        bodies = Counter()
        for r in docs.collect():
            bodies[(r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (0,))] += 1
        packed = pack(docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=True).cache()
        rows = packed.collect()
        by_doc = defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            assert 0 < r.length <= 2048 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        total = sum(len(b) * n for (_, b), n in bodies.items())
        assert sum(r.length for r in rows) == total
        for (doc, body), n in bodies.items():
            if n == 1 and doc is not None:
                parts = sorted(by_doc[doc], key=lambda r: r.piece)
                assert [r.piece for r in parts] == list(range(len(parts)))
                assert tuple(x for r in parts for x in r.ids) == body
                assert len(parts) == -(-len(body) // 2048)
                assert all(r.length == 2048 for r in parts[1:])
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= -(-total // 2048) * 1.03 + 1
        assert sorted(len(r.ids) for r in sequences(packed).collect()) == sorted(sum(n for _, n in p) for p in bins.values())
        packed.unpersist()


def test_plan_is_complete_and_full():
    import random

    random.seed(3)
    counts = Counter(random.choice((random.randint(1, 50), random.randint(1, 300))) for _ in range(2000))
    made = plan(dict(counts), 300)
    used = Counter()
    for times, combination in made:
        assert sum(length * n for length, n in combination) <= 300
        for length, n in combination:
            used[length] += n * times
    assert used == counts
    assert sum(t for t, _ in made) <= -(-sum(k * v for k, v in counts.items()) // 300) + 1
    for _ in range(50):
        some = Counter(random.randint(1, 12) for _ in range(random.randint(0, 6)))
        room = random.randint(0, 30)
        sums_ = {0}
        for x in some.elements():
            sums_ |= {s + x for s in sums_}
        best = fullest(dict(some), room)
        assert sum(x * n for x, n in best) == max(s for s in sums_ if s <= room)
        assert all(n <= some[x] for x, n in best)


def test_both_libraries_give_the_same_ids():
    """Words met for the first time go through the quicker library; ids are those of the tokenizer file."""
    from tokenizers import Tokenizer

    from songloom.llm import tokens

    path = tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(9)
    kinds = ["abcdefgh", "aeiouthnst", "ABCxyz0123456789", "éèüßñçÀÖ×÷ø", "'\"!?.,;:-_()<>|", "日本語кот", "\t\n\x0b\x1c\u00a0\u2003", "😀👍🏽"]

    def word():
        return "".join(rng.choice(rng.choice(kinds[:5] if rng.random() < 0.9 else kinds)) for _ in range(rng.randint(1, 12)))

    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) + rng.choice(["", " ", "  x", "<|endoftext|>", "it's we'll  'd"]) for _ in range(400)]
    plain = Tokenizer.from_file(path)
    for quick in (True, False):
        pieces = tokens.PieceIds(path)
        assert pieces.quick is not None
        pieces.quick = pieces.quick if quick else None
        for begin in range(0, len(texts), 100):
            part = texts[begin : begin + 100]
            ids, starts = tokens.encoded(pa.array(part), pieces)
            got = [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
            assert got == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("operator", ["mixed", "exact", "near"])
def test_names_of_ours_may_be_columns(spark, operator):
    """Columns that are called as the operators' own come back as they were."""
    from songloom.llm.ngram_join import without_near_copies

    names = ["_key", "_doc", "_copies", "_nth", "_norm", "_id", "_row", "rows", "total", "doc", "size", "id", "key"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    own = lambda i: tuple(f"{n}{i}" for n in names)
    texts = ["one two three four five six", "One two three four five six", "seven eight nine ten eleven", None, "a b c d e f g"]
    rows = [(i, t, f"s{i % 2}", *own(i)) for i, t in enumerate(texts)] + [(1, "One two three four five six", "s1", *own(1))]
    docs = spark.createDataFrame(rows, schema)
    calls = {"mixed": lambda d: mixed_documents(d, (3.0, 1.0, 2.0)), "exact": without_copies, "near": without_near_copies}
    got = calls[operator](docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert kept and all(tuple(r)[3:] == own(r.doc_id) for r in kept)
    if operator == "exact":
        assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4]
    bare = docs.select("doc_id", "text", "source")
    plain = calls[operator](bare).collect()
    assert sorted(map(str, plain)) == sorted(str(r) for r in got.select("doc_id", "text", "source").collect())
