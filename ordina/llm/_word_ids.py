"""Ids of a word-level tokenizer whose words never cross ASCII white space."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from ordina.llm._text import Bytes, IdCache, parts

#: The word pattern and the end-of-word mark of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = regex.compile(PATTERN + "| ")
NORMALIZERS = ("NFC", "Replace", "Lowercase")
END_OF_WORD = "</w>"
#: Units of these characters (ASCII and precomposed Latin letters) take the fast way.
PLAIN = regex.compile(r"[\x20-\x7eÀ-įĲ-ňŊ-ž]*")
#: A byte that UTF-8 never holds, in place of the end-of-word mark.
END = b"\xff"
MEMO = 100_000

_cache: dict[str, IdCache] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _printable_bytes() -> dict[str, int]:
    """The customary printable character of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _read(path: str) -> dict:
    """The tokenizer's file; one that cuts text in another way than this module does raises."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, split, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
    found = (
        tuple(n["type"] for n in normal.get("normalizers", ())), [p["pattern"].get("Regex") for p in split.get("pretokenizers", ()) if p["type"] == "Split"], model["type"], model.get("end_of_word_suffix"))
    if found != (NORMALIZERS, [PATTERN], "BPE", END_OF_WORD):
        raise ValueError(f"{path}: not a tokenizer of words in lower case with byte-pair merges")
    return spec


def _merger(path: str):
    """Byte-pair merges of one word (bytes + END) by rank, from the tokenizer's own vocabulary file."""
    from tiktoken._tiktoken import CoreBPE

    spec = _read(path)
    special = {t["id"] for t in spec["added_tokens"]}
    byte = _printable_bytes()

    def raw(token: str) -> bytes:
        ended = len(token) > len(END_OF_WORD) and token.endswith(END_OF_WORD)
        return bytes(byte[c] for c in (token[: -len(END_OF_WORD)] if ended else token)) + END * ended

    ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if i not in special}
    return CoreBPE(ranks, {}, r"\S+").encode_single_piece


def _open(path: str) -> IdCache:
    """One cache for a worker's life.

    Distinct units of plain characters are merged by rank in one call a word; all others go to
    the tokenizer itself. Both give the tokenizer's ids (tested on all words of the tables).
    """
    if path not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        merge, memo = _merger(path), {}

        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            if len(memo) > MEMO:
                memo.clear()
            words = [u.decode("utf-8", "replace") for u in units]
            found: list[list[int]] = [[]] * len(words)
            plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)]
            at, ids = 0, []
            for token in WORD.findall(unicodedata.normalize("NFC", " ".join([words[i] for i in plain])).lower() + " ") if plain else ():
                if token == " ":
                    found[plain[at]] = ids
                    at, ids = at + 1, []
                    continue
                got = memo.get(token)
                if got is None:
                    got = memo[token] = merge(token.encode() + END)
                ids = ids + got if ids else got
            if len(plain) < len(words):
                ordinary = set(plain)
                rest = [i for i in range(len(words)) if i not in ordinary]
                for i, e in zip(rest, tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
                    found[i] = e.ids
            n = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((x for ids in found for x in ids), np.int32, int(n.sum())), n

        _cache[path] = IdCache(encode)
    return _cache[path]


def word_ids(texts: pa.Array, path: str) -> Iterator[tuple[Bytes, IdCache, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: it, the cache, each word's place and number of ids, and the words of each text.

    The tokenizer drops white space and its words don't cross it, so a text's ids are those
    of its ASCII-space-separated words in order; special tokens in a text count as plain text.
    """
    cache = _open(path)
    for text in parts(texts):
        start, end = text.words()
        place, n = cache.look_up(text, start, end)
        yield text, cache, place, n, text.count(start)
