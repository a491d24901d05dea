"""Token ids by the tokenizers library, each distinct chunk of text encoded once per worker.

Both supported pre-tokenizers cut a text at white space before any merge, so the ids of a text are the ids of its
chunks, one after another. A worker keeps the ids of the chunks that it has met, in a table of bounded size, and
passes only new ones to the library: runs of Latin letters, which no pre-tokenizer cuts any more, to its normaliser and
model, others to all of it. Texts that hold one of the vocabulary's special strings, and vocabularies whose
pre-tokenizer is another, go to the library whole.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks: a run of ASCII letters up to white space or a mark (a pre-token of its own, which many texts share), else
#: whatever has no white space. White space is as the library's patterns have it: Python's, but for four control characters.
_BYTE_CHUNK = re.compile(r" ?[A-Za-z]+(?=[\s.,!?;:]|\Z)| ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
_WORD_CHUNK = re.compile(rb"[a-z]+(?=[\s.,!?;:]|\Z)|\S+")
#: The byte-level alphabet: printable characters of Latin-1 stand for themselves, other bytes for those from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}

#: Chunks that a worker keeps at most; beyond, the table starts anew (the ids stay the same, some are computed again).
KEPT_CHUNKS = 1_000_000


def _style(path: str) -> tuple[str, list[str]]:
    """How texts may be cut: "byte" (a space belongs to what follows), "word" (white space and case are dropped), "" (not at all)."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    special = [t["content"] for t in config.get("added_tokens") or []]
    pre = config.get("pre_tokenizer") or {}
    if not config.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        return "byte", special
    steps = pre.get("pretokenizers") or []
    drops = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    pattern = (steps[0].get("pattern") or {}).get("Regex", "") if drops else ""
    lowers = any(n.get("type") == "Lowercase" for n in (config.get("normalizer") or {}).get("normalizers") or [])
    if lowers and drops and pattern.endswith(r"[^\s\p{L}\p{N}]+") and not any(re.search(r"\s", s) for s in special):
        return "word", special
    return "", special


class _Known(dict):
    """Ids of chunks, as little-endian unsigned 32-bit integers; one that is missing is encoded."""

    def __init__(self, library):
        super().__init__()
        self.library, self.tokenize, self.normalizer = library, library.model.tokenize, library.normalizer

    def _spelled(self, letters: str) -> str | None:
        """Latin letters as the model has them, normalised and byte by byte; None if they may be cut before."""
        if not letters.isalpha() or max(letters) >= "\u0250":
            return None
        if letters.isascii():
            return letters  # lower case already where case is dropped
        if self.normalizer is not None and not (letters := self.normalizer.normalize_str(letters)).isalpha():
            return None
        return letters.encode().decode("latin-1").translate(_ALPHABET)

    def __missing__(self, chunk) -> bytes:
        text = chunk.decode() if isinstance(chunk, bytes) else chunk
        letters = text.removeprefix(" ")
        if (spelled := self._spelled(letters)) is not None:
            ids = [t.id for t in self.tokenize("\u0120" * (len(text) - len(letters)) + spelled)]
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        found = self[chunk] = array.array("I", ids).tobytes()
        return found


class Encoder:
    """encode(texts): for each text, its ids as little-endian unsigned 32-bit integers; null counts as empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.style, self.special = _style(path)
        self.special_bytes = [s.lower().encode() for s in self.special]
        self.known = _Known(self.library)

    def _chunks(self, text: str) -> list:
        """The pieces of a text that are encoded by themselves: all of it where it can't be cut."""
        if self.style == "word":
            low = text.encode().lower()  # A-Z alone
            if not any(s in low for s in self.special_bytes):
                return _WORD_CHUNK.findall(low)
        elif self.style == "byte" and not any(s in text for s in self.special):
            return _BYTE_CHUNK.findall(text)
        return []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            if len(known) > KEPT_CHUNKS:
                known.clear()
            if chunks := self._chunks(text or ""):
                out.append(b"".join(map(known.__getitem__, chunks)))
            else:
                out.append(array.array("I", self.library.encode(text or "", add_special_tokens=False).ids).tobytes())
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def in_groups(texts: list, most: int = 1_000_000):
    """Slices of a list of texts of about so many characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
