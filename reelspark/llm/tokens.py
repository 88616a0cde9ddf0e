"""Token ids of whole texts, by a byte-level BPE vocabulary file of the tokenizers library.

Such a vocabulary splits a text before it merges, and no split spans the place before a
single space that a word follows. So a text can be cut there, and the ids of a piece
depend on that piece alone: repeated pieces come from a bounded cache.
"""

from __future__ import annotations

import json
from array import array

#: Pieces that a worker remembers; further ones are encoded each time.
CACHED = 200_000
#: Longer pieces are encoded without being remembered.
CACHED_CHARS = 40

_encoders: dict[str, "Encoder"] = {}


def _bytes_of() -> dict[str, int]:
    """The printable stand-in of each byte in such files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def _split_pattern(spec: dict) -> str | None:
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" if plain and not spec.get("normalizer") else None


class Encoder:
    """Little-endian unsigned 32-bit ids of a text as bytes; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        self.slow = self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("type") == "BPE" and (pattern := _split_pattern(spec)):
            self.fast = self._by_rank(spec, pattern)
        if self.fast is None:  # else the other isn't loaded, as a worker holds one of them for long
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}

    def _by_rank(self, spec: dict, pattern: str):
        """The same merges as ranks, if ids follow the order of merging; else None."""
        import tiktoken

        vocab, stands = spec["model"]["vocab"], _bytes_of()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(made) or not all(c in stands for t in vocab for c in t if t not in {x["content"] for x in spec.get("added_tokens", [])}):
            return None
        added = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(stands[c] for c in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, piece: str) -> bytes:
        ids = self.fast.encode_ordinary(piece) if self.fast else self.slow.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _piece(self, word: str) -> bytes:
        """Ids of a space and this word."""
        got = self.cache.get(word)
        if got is None:
            got = self._ids(" " + word)
            if len(word) <= CACHED_CHARS and len(self.cache) < CACHED:
                self.cache[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None:
            return self._ids(text)
        first, *words = text.split(" ")
        get, out = self.cache.get, []
        held = first  # what came before and isn't encoded yet, as it may go on
        for w in words:
            if w and not w[0].isspace():
                if held is not None:
                    out.append(self._ids(held))
                    held = None
                got = get(w)
                out.append(self._piece(w) if got is None else got)
                last = w
            elif held is not None:
                held += " " + w
            else:  # white space after a word belongs with it
                out.pop()
                held = " " + last + " " + w
        if held is not None:
            out.append(self._ids(held))
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
