"""Pre-tokenisation and merging against the tokenizer libraries."""

import random

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

from codexmill.llm import bpe, packing, queries

TOKENIZER = queries.tokenizer_file("byte_bpe_50k.json")


def test_classes_of_all_code_points_equal_the_libraries():
    """After "a" a letter, and after "1" a number, is in one piece with it, which a merge of both bytes shows."""
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    tokens = [bytes([i]) for i in range(256)] + [first + bytes([x]) for first in (b"a", b"1") for x in range(0x80, 256)]
    library = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    for first, kind in (("a", bpe.LETTER), ("1", bpe.NUMBER)):
        ids = np.array(library.encode_ordinary("".join(f"{first}{chr(c)}\n" for c in points)))
        merged = ids[np.concatenate([[0], np.flatnonzero(ids == 10)[:-1] + 1])] >= 256
        assert ((bpe.classes()[points] == kind) == merged).all()
    pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for a, b in bpe.ADDED_LETTERS + bpe.ADDED_NUMBERS:
        for c in (a - 1, a, b, b + 1):
            for first, kind in (("a", bpe.LETTER), ("1", bpe.NUMBER)):
                assert (len(pieces.pre_tokenize_str(first + chr(c))) == 1) == (bpe.classes()[c] == kind)


def test_packing_ids_equal_the_library():
    rnd = random.Random(9)
    letters = list("\'\'\'ssttrrevemlld  \n\t aeioàЖ漢٣5²!?-😀\x85 ") + ["<|endoftext|>", "the", " and"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["", "ab" * 3000, "é" * 70]
    plain = Tokenizer.from_file(TOKENIZER)
    ids, ends = packing.tokenizer(TOKENIZER)(texts)
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert packing.read_ranks(TOKENIZER) is not None
    assert packing.read_ranks(queries.tokenizer_file("word_bpe_49k.json")) is None


def test_pieces_by_hand():
    ids, ends = np.array([5, 6, 7, 8, 9], "<u4"), np.array([0, 4, 5])
    row, start, size, crc, whole = packing.cut_up(ids, ends, 3, 1)
    assert (row.tolist(), start.tolist(), size.tolist(), whole.tolist()) == ([0, 1, 1, 2], [0, 0, 3, 0], [1, 3, 2, 2], [1, 5, 5, 2])
    assert len(set(crc.tolist())) == 4
