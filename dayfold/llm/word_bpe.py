"""Ids of tokenizer files whose words end in a mark (`</w>`), run as rank merges.

Such a file lower-cases the text, drops white space and splits the rest by a pattern; each part is merged with
an end mark behind its last byte. The mark is the byte 0xFF here, which no UTF-8 text has: the file's first
merges put it behind a single byte, so it is merged before all others, as the file wants. Ranks are then the
ids. Texts outside the first Unicode blocks, or with an added token in them, are cut at ASCII spaces, and
what is unusual in them goes to the tokenizer's own library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from dayfold.llm.packing import _byte_letters

#: Code points below this one are lower-cased and split here; composed text of these blocks is in normal form C.
PLAIN = 0x250
MARK = b"\xff"
#: Parts whose ids a worker remembers.
REMEMBERED = 200_000
SPACES = re.compile("[ \n\r\t]+")
# fixed value: the pattern that such files split by
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_pattern() -> re.Pattern:
    """PATTERN for the plain code points, its classes written out."""
    plain = [chr(i) for i in range(PLAIN)]
    letters = "".join(c for c in plain if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in plain if unicodedata.category(c)[0] == "N")
    spaces = "\t\n\x0b\x0c\r \x85\xa0"
    classes = PATTERN.replace(r"\p{L}", re.escape(letters)).replace(r"\p{N}", re.escape(numbers)).replace(r"\s", re.escape(spaces))
    return re.compile(classes)


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The file's vocabulary as ranks; None if it is not of this kind or its ids are not in merge order."""
    model, cut = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or spec.get("post_processor"):
        return None
    if cut[0].get("pattern") != {"Regex": PATTERN} or cut[0].get("behavior") != "Removed" or not cut[0].get("invert"):
        return None
    vocab, byte = model["vocab"], _byte_letters()
    joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if joined != sorted(joined) or joined[0] < 512:
        return None
    return {bytes(map(byte.__getitem__, w.removesuffix("</w>"))) + MARK * w.endswith("</w>"): i for w, i in vocab.items()}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids, unsigned 32-bit little-endian; nothing is put around a text.

    The ids are those of the library with the file as it is: added tokens that a text spells out keep their own.
    """
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = _ranks(spec)

    def by_library(text: str) -> bytes:
        return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if ranks is None:
        return by_library
    merge = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    added = [t["content"] for t in spec.get("added_tokens", [])]
    parts_of = _plain_pattern().findall
    unusual = re.compile(f"[^\x00-{chr(PLAIN - 1)}]|İ").search
    known: dict[str, bytes] = {}
    words: dict[str, bytes] = {}

    def of_parts(text: str) -> bytes:
        parts = parts_of(text.lower())
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for p in parts:
                if p not in known:
                    known[p] = np.array(merge(p.encode() + MARK), "<u4").tobytes()
            return b"".join(map(known.__getitem__, parts))

    def of_word(word: str) -> bytes:
        if word not in words:
            if len(words) > REMEMBERED:
                words.clear()
            words[word] = by_library(word) if unusual(word) or any(a in word for a in added) else of_parts(word)
        return words[word]

    def encoded(text: str) -> bytes:
        if not unusual(text) and not any(a in text for a in added):
            return of_parts(text)
        return b"".join(map(of_word, SPACES.split(text)))

    return encoded
