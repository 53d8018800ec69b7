"""Token counts and ids by the installed tokenizers.

Counts are memoised per word inside an executor's Python process: the vocabulary splits a text at white space before
merging, so a text's tokens are those of its words, one after the other. The library itself encodes each distinct word once
per process; the memo drops entries when full, which changes time only.

Ids of a byte-level vocabulary are those of its file whichever library merges the bytes; whole texts go to the one
that merges them in a fifth of the time, texts with a special token's string to the vocabulary's own library.
"""

from __future__ import annotations

import json
import os
from itertools import islice

import numpy as np

MEMO_ENTRIES = 700_000

_loaded: dict = {}


def tokenizer(path: str):
    """One tokenizer per process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return _loaded[path]


_memos: dict[tuple[str, str], dict] = {}


def _memo(kind: str, path: str) -> dict:
    """Words seen so far. A full memo keeps its older half: frequent words come early."""
    memo = _memos.setdefault((kind, path), {})
    if len(memo) > MEMO_ENTRIES:
        memo = _memos[kind, path] = dict(islice(memo.items(), MEMO_ENTRIES // 2))
    return memo


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text under a vocabulary whose tokenizer drops white space."""
    memo, encode = _memo("count", path), tokenizer(path).encode_batch_fast
    words = [t.encode("utf-8").split() for t in texts]
    missing = list(set().union(*words).difference(memo))
    for start in range(0, len(missing), 20_000):
        part = missing[start : start + 20_000]
        memo.update(zip(part, (len(e) for e in encode([w.decode("utf-8") for w in part], add_special_tokens=False))))
    return [sum(map(memo.__getitem__, ws)) for ws in words]


# the splitting rule of byte-level vocabularies of this kind: a fixed value
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _shown_bytes() -> dict[str, int]:
    """Byte of each character that stands for one in a byte-level vocabulary: printable ones as they are, others from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_ranks(path: str):
    """The vocabulary as ranks of byte strings, and its special strings; None for a file of another kind.

    Ids serve as ranks where every merge makes the id after the one before.
    """
    if ("ranks", path) not in _loaded:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, split = content["model"], content.get("pre_tokenizer") or {}
        vocabulary, merges = model.get("vocab"), model.get("merges")
        plain = (
            content.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
            and all(vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + i for i, m in enumerate(merges))
        )
        specials = [t["content"] for t in content.get("added_tokens", [])]
        if plain:
            shown = _shown_bytes()
            ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if token not in specials}
            import tiktoken

            _loaded["ranks", path] = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), specials
        else:
            _loaded["ranks", path] = None
    return _loaded["ranks", path]


def encode_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text under a byte-level vocabulary, as little-endian unsigned 32-bit integers."""
    library, ranked = tokenizer(path), byte_ranks(path)
    out = []
    for text in texts:
        if ranked is None or any(special in text for special in ranked[1]):
            ids = library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        else:
            ids = ranked[0].encode_ordinary(text)
        out.append(np.array(ids, dtype="<u4").tobytes())
    return out
