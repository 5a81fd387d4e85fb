"""Token ids of whole texts through a public tokenizer, with a bounded cache of words.

A text is cut at blanks, line feeds and tabs only. The tokenizer's own pattern never lets a token cross white space,
so ids of the pieces, one after another, are the ids of the text; words recur, so most pieces come from the cache.
Texts without characters beyond U+024F are lower-cased first (the tokenizer does that itself) and have a comma or full
stop between a letter and white space cut off (the tokenizer's pattern cuts there too), which makes for fewer different
pieces. Words that are new and made of lower-case Latin letters alone, which the tokenizer neither normalises nor cuts, are
encoded many at a time by the same model without those steps; the ids that end a word tell them apart. ``encode`` returns ids as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Name of the vocabulary file that the queries use; the folder is that of the installed package.
WORD_BPE = "word_bpe_49k.json"


def default_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_FAR = re.compile("[^\x00-\u024f]").search
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_STOPS = re.compile(r"(?<=[a-z])([,.])(?=[ \n])").sub


class WordTokens:
    """Ids by ``tokenizers`` for a vocabulary that lower-cases and drops white space.

    The cache has two generations of at most ``max_words`` words; words that are met again move to the younger one.
    """

    def __init__(self, path: str, max_words: int = 500_000, max_word_chars: int = 64, max_chars: int = 6_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare, self.ends = None, np.zeros(0, dtype=bool)
        spec = json.loads(self.tokenizer.to_str())
        if spec["model"].get("end_of_word_suffix") == "</w>":
            spec["normalizer"] = None
            byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}
            self.bare = Tokenizer.from_str(json.dumps(spec))
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.max_words, self.max_word_chars, self.max_chars = max_words, max_word_chars, max_chars
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as the empty text."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= self.max_chars:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _plain(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.bare.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [(t if _FAR(t) else _STOPS(r" \1", t.lower())).replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.young) > self.max_words:
            self.old, self.young = self.young, {}
        young = self.young
        missing = set().union(*cut) - young.keys()
        for w in missing & self.old.keys():
            young[w] = self.old[w]
        unknown = list(missing - young.keys())
        if unknown:
            plain = [w for w in unknown if _PLAIN(w)] if self.bare else []
            for lo in range(0, len(plain), 500):
                some = plain[lo : lo + 500]
                young.update(zip(some, self._plain(some), strict=True))
            other = [w for w in unknown if w not in young]
            for w, code in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False), strict=True):
                young[w] = np.array(code.ids, dtype="<u4").tobytes()
        get = young.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        for w in unknown:  # long pieces are rare and large: they are not kept
            if len(w) > self.max_word_chars:
                del young[w]
        return out


_OPEN: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    """One tokenizer for each file and worker process."""
    if path not in _OPEN:
        _OPEN[path] = WordTokens(path)
    return _OPEN[path]
