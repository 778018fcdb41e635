"""Byte-level BPE of a tokenizer file, fast where that gives the library's own ids.

The ``tokenizers`` library defines the ids. Its speed is not enough for whole corpora, so texts are encoded by
``tiktoken`` from the same file's vocabulary, where both must agree: the driver checks once that merges stand in
the order of their ids, that the file does nothing else to a text, and that the words of the vocabulary encode to
themselves. What may still differ is what the two take for a letter, number or space, so every character is
probed among letters, numbers, signs and spaces before it is trusted (common ones by the driver, others on
first sight); texts with others are encoded by the library itself.

Special tokens' strings inside texts are plain text. Null and empty texts have no ids.
"""

from __future__ import annotations

import json
import re

#: Code points probed by the driver; the rest are probed where they are met.
COMMON = range(0x80, 0x2600)
#: What splits a text before merges, as the byte-level splitter of the library does it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space are left to the library: the fast one's splitter would overflow its stack.
LONG_SPACE = 4096
LONG_RUN = re.compile(rf"\s{{{LONG_SPACE}}}")
ALIKE = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def file_bytes(path: str | None = None, name: str = "byte_bpe_50k.json") -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class ByteBpe:
    """encode(text) gives the library's ids; ``tokens[i]`` are the bytes of id i."""

    def __init__(self, file: bytes, probed: tuple[bool, frozenset[str]] | None = None):
        self.file = file
        spec = json.loads(file)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"].encode()
        self._library = None
        if probed is None:
            probed = self._probe(spec, special)
        self.alike, self.odd = probed[0], set(probed[1])
        self.known = {chr(c) for c in range(0x80)} | {chr(c) for c in COMMON}
        if self.alike:
            self.fast = self._tiktoken(vocab, special)

    def _tiktoken(self, vocab: dict[str, int], special: set[str]):
        import tiktoken

        ranks = {self.tokens[i]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @property
    def library(self):
        if self._library is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.file.decode())
            self._library.encode_special_tokens = True
        return self._library

    def slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _probe(self, spec: dict, special: set[str]) -> tuple[bool, frozenset[str]]:
        """Whether the two libraries can agree at all, and the common characters on which they don't."""
        model = spec["model"]
        pre = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and all(pre.get(k) == v for k, v in ALIKE["pre_tokenizer"].items()) and all(model.get(k) == v for k, v in PLAIN_MODEL.items())
        if not plain:
            return False, frozenset()
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        vocab = model["vocab"]
        order = [vocab["".join(m.split(" "))] for m in merges]
        if order != sorted(order):
            return False, frozenset()
        words = {}
        for t, i in vocab.items():
            try:
                words[self.tokens[i].decode()] = i
            except UnicodeDecodeError:  # no whole word of a text can be this token
                continue
        words = {w: i for w, i in words.items() if w not in special}
        whole = self.library.encode_batch(list(words), add_special_tokens=False)
        if any(len(e.ids) != 1 and len(self.library.pre_tokenizer.pre_tokenize_str(w)) == 1 for w, e in zip(words, whole, strict=True)):
            return False, frozenset()
        self.fast = self._tiktoken(vocab, special)
        if any(self._differs(chr(c)) for c in range(0x80)):
            return False, frozenset()
        return True, frozenset(chr(c) for c in COMMON if self._differs(chr(c)))

    def probed(self) -> tuple[bool, frozenset[str]]:
        """What an executor needs not find out again."""
        return self.alike, frozenset(self.odd)

    def _differs(self, c: str) -> bool:
        among = f"a{c}a 1{c}1 !{c}! {c} {c}{c}\n{c}'s{c}  {c}"
        return self.fast(among) != self.slow(among)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.alike or (len(text) > LONG_SPACE and LONG_RUN.search(text)):
            return self.slow(text)
        if not text.isascii():
            here = set(text)
            new = here - self.known
            if new:
                self.odd |= {c for c in new if self._differs(c)}
                self.known |= new
            if self.odd and not self.odd.isdisjoint(here):
                return self.slow(text)
        return self.fast(text)
