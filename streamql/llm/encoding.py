"""Token ids of byte-level BPE tokenizers, fast enough for whole corpora.

The vocabulary is a tokenizer file given by its path; the driver reads it and sends its
content (a few MB) to the executors, which need no file. Texts are cut before single
spaces, where no token can cross, and the ids of each piece are remembered in a bounded
cache. Where that cut could change the tokens (a space inside a longer run of white
space) the text is encoded whole. Ids are those of the tokenizers library; if a file's
merges don't follow its ids, that library encodes the pieces itself.
"""

import functools
import json
import re

import numpy as np

CACHED = 400_000
LONGEST_CACHED = 64
#: A space that has white space before it and white space or the end after it.
UNSAFE = re.compile(r"\s (?:\s|\Z)")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_spec(path: str | None = None) -> tuple[str, str]:
    """(content of the tokenizer file, its pre-token pattern), to be broadcast."""
    import public_tokenizers

    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return f.read(), public_tokenizers.PATTERN


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable letters: these stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Cache(dict):
    def __init__(self, encode, prefix):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, piece):
        ids = self.encode(self.prefix + piece)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, spec: tuple[str, str]):
        content, self.pattern = spec
        model = json.loads(content)
        vocab, letters = model["model"]["vocab"], _bytes_of_letters()
        added = [t for t in model.get("added_tokens", ()) if t.get("special")]
        special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        # Tokens that take white space or word bounds along are left to the library.
        self.odd = any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.special, self.content = special, content
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["model"]["merges"]]
        if None not in merged and all(a < b for a, b in zip(merged, merged[1:])):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
            own = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            self.ids = own.encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(content)
            whole.encode_special_tokens = True
            self.ids = lambda s: whole.encode(s, add_special_tokens=False).ids
        self.piece = lambda s: np.array(self.ids(s), dtype="<u4").tobytes()
        self.first, self.rest = _Cache(self.piece, ""), _Cache(self.piece, " ")

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.content)

    def encode(self, text: str, special: bool = False) -> bytes:
        """special: strings of special tokens become these tokens."""
        if special and any(s in text for s in self.special):
            if self.odd:
                return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return b"".join(self.special[x] if i % 2 else self.encode(x) for i, x in enumerate(self.at_special.split(text)) if x)
        if UNSAFE.search(text):
            return self.piece(text)
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


@functools.lru_cache(maxsize=2)
def encoder(spec: tuple[str, str]) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(spec)
