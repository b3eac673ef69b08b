import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm.tables import AWKWARD, documents
from turnout.llm import bpe, counts, repair
from turnout.llm.pieces import Memo

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTENT = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
SNIPPETS = [*"ab cdeé漢 \n\t'sS19.,<|> 　", "<|endoftext|>", " the", " token", "  "]
TEXTS = st.lists(st.lists(st.sampled_from(SNIPPETS), max_size=60).map("".join), min_size=1, max_size=6)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_coders_equal_the_library(texts):
    assert [x.tolist() for x in bpe.coder(CONTENT).encode(texts)] == [ids(t) for t in texts]
    assert list(counts.counter(CONTENT).memo.values(texts)) == [len(ids(t)) for t in texts]
    memo, _ = repair.encoder(CONTENT)
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.values(texts)] == [ids(t) for t in texts]


def test_many_new_pieces_at_once():
    import random
    own = random.Random(6)
    parts = ["", "ab", "Zé", "12", "'s", "\n", "<|endoftext|>", "x.y", "漢", "-", "\t", "'", "|"]
    tails = ["", ".", ",", "###", "%%%", "|", "*'", "'s", ">", "\n", "?!"]
    texts = [" ".join("".join(own.choice(parts) for _ in range(3)) + str(own.randrange(900)) * own.randrange(2) + own.choice(tails) for _ in range(400)) for _ in range(30)]
    memo, _ = repair.encoder(CONTENT)
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.values(texts)] == [ids(t) for t in texts]
    assert [x.tolist() for x in bpe.coder(CONTENT).encode(texts)] == [ids(t) for t in texts]
    assert list(counts.counter(CONTENT).memo.values(texts)) == [len(ids(t)) for t in texts]


def test_scan_and_heap_agree():
    own = bpe.coder(CONTENT)
    for word in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaa", bytes(range(256)), b"thethethethe" * 30):
        assert own._scan(word) == own._heap(word)


def test_thousands_of_special_strings():
    texts = ["a\n<|endoftext|>\n" * 3000, "<|endoftext|>" * 5000, "x <|endoftext|>  y" * 2000]
    assert [x.tolist() for x in bpe.coder(CONTENT).encode(texts)] == [ids(t) for t in texts]


def test_memo_forgets_beyond_its_bound():
    memo = Memo(lambda texts: [t.encode() for t in texts], b"".join, limit=3)
    texts = [" ".join(f"w{n + k}" for k in range(5)) for n in range(50)]
    for text in texts:
        assert list(memo.values([text])) == [text.encode()]
    assert len(memo.known) < 20


def test_digests_and_counts_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    want = sorted((d or -1, len(ids(t)), hashlib.sha256(",".join(map(str, ids(t))).encode()).hexdigest(),
                   hashlib.sha256(LIBRARY.decode(ids(t), skip_special_tokens=False).encode()).hexdigest()) for d, t in AWKWARD)
    assert sorted((r[0] or -1, *r[1:]) for r in bpe.digests(docs, PATH).collect()) == want
    got = sorted((r[0] or -1, *r[1:]) for r in counts.token_counts(docs, PATH).collect())
    assert got == sorted((d or -1, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t in AWKWARD)
    assert sorted((r[0] or -1, r[1]) for r in bpe.encoded(docs, PATH).collect()) == sorted((d or -1, ids(t)) for d, t in AWKWARD)
    none = docs.limit(0)
    assert bpe.digests(none, PATH).count() == counts.token_counts(none, PATH).count() == bpe.encoded(none, PATH).count() == 0


def test_files_hold_the_ids(spark):
    rows = sorted(((d if d is not None else -1, t or "") for d, t in AWKWARD))
    at, want = 0, []
    for doc_id, text in rows:
        own = ids(text) + [repair.END]
        want.append((doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = [(r[0] if r[0] is not None else -1, *r[1:]) for r in repair.packed(documents(spark, AWKWARD), PATH).collect()]
    assert sorted(got) == sorted(want)
    assert repair.packed(documents(spark, AWKWARD).limit(0), PATH).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=200), min_size=1, max_size=6), st.sampled_from([5, 60_000]))
def test_grammar_round_trip(docs, base):
    lengths = np.array([len(d) + 1 for d in docs])
    flat = np.array([n for d in docs for n in [*d, 0]], np.uint32)
    g = repair.compressed(flat, lengths, base)
    u4 = lambda x: x.astype("<u4").tobytes()
    block = repair.Block.read(base, g.symbols.dtype.itemsize, u4(lengths), u4(g.doc_symbols), u4(g.rules), u4(g.expansions), g.symbols.tobytes())
    terminals = [np.array([n], "<u4").tobytes() for n in range(base)]
    assert [np.frombuffer(d, "<u4").tolist() for d in block.documents(terminals)] == [[*d, 0] for d in docs]
    for start in (0, len(flat) // 3, max(0, len(flat) - 3)):
        assert block.ids(start, min(len(flat), start + 7)) == flat[start:start + 7].tolist()


def test_frequent_pairs_become_rules():
    flat = np.array([1, 2, 3, 4] * 500, np.uint32)
    g = repair.compressed(flat, np.array([len(flat)]), 10)
    assert len(g.rules) and len(g.symbols) < len(flat) / 4


def test_grammars_grow_until_no_pair_is_frequent():
    """A long repeat takes more rounds than its rules have doublings, and nothing frequent is left behind."""
    own = np.random.default_rng(8)
    unit = own.integers(0, 500, 256).astype("<u4")
    ids = np.concatenate([np.tile(unit, 200), own.integers(0, 500, 5000).astype("<u4")])
    lengths = np.array([len(ids) - 5000, 5000])
    g = repair.compressed(ids, lengths, 1000)
    assert g.expansions.max() >= 256
    pairs = [p for part in np.split(g.symbols.astype(int), np.cumsum(g.doc_symbols)[:-1]) for p in zip(part, part[1:])]
    count = {}
    last = None
    for p in pairs:
        if p == last and p[0] == p[1]:  # of overlapping equal pairs every other counts
            last = None
            continue
        count[p] = count.get(p, 0) + 1
        last = p
    assert max(count.values()) < repair.FREQUENT
    out = []
    for s in g.symbols.tolist():
        stack = [s]
        while stack:
            x = stack.pop()
            if x < g.base:
                out.append(x)
            else:
                a, b = g.rules[x - g.base].tolist()
                stack += [b, a]
    assert out == ids.tolist()
