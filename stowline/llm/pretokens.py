"""Pre-tokens of word_bpe_49k.json and a worker-side cache of their encodings.

The tokenizer normalises (NFC, white space, lower case), cuts the text into pre-tokens and encodes each of
them on its own, so a text's ids are the ids of its pre-tokens in turn. Texts of plain Latin letters are cut
here. No pre-token holds a blank and no letter combines with one, so any other text is first cut at its blanks:
plain pieces are cut further here, and a piece with rare characters or the start of a special string stays
whole, as one entry that the library encodes once. So both tiers serve every text.
"""

from __future__ import annotations

import re

# Characters for which lower-casing and NFC are the same in every Unicode version, without
# white space other than blank, tab and line ends; letters and numbers among them.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ]*")
_LETTERS = "a-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r{_LETTERS}{_NUMBERS}]+")


_BLANKS = re.compile("[ \t\n\r]+")
#: Longer entries are encoded each time and kept by no table, so that the count of entries bounds the memory.
MOST_KEPT = 256


def _rare(text: str) -> bool:
    return "<|" in text or not _PLAIN.fullmatch(text)


def pretokens(text: str) -> list[str]:
    """The text's pre-tokens; a piece between blanks where only the library can cut stays whole."""
    if not _rare(text):
        return _PRETOKEN.findall(text.lower())
    out: list[str] = []
    for piece in _BLANKS.split(text):
        if _rare(piece):
            out.append(piece)
        else:
            out += _PRETOKEN.findall(piece.lower())
    return out


def _byte_letters() -> dict[int, int]:
    """The byte-level step's letters: printable bytes stand for themselves, the others for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in shown)}


class _Cache(dict):
    """Values by pre-token; what is missing is fetched from the older generation or made."""

    def __init__(self, make_one, start: dict):
        super().__init__(start)
        self.old: dict = {}
        self.make_one = make_one
        self.misses = 0

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            self.misses += 1
            value = self.make_one(word)
        if len(word) <= MOST_KEPT:
            self[word] = value
        return value


class PretokenCoder:
    """Encodes texts through two tiers: a fixed table, then a bounded cache that library calls fill.

    make(ids) turns a pre-token's ids into what is kept for it. The cache has two generations: when the young
    one is full it becomes the old one, and what is still in use moves back. So memory stays bounded and
    frequent pre-tokens stay.
    """

    def __init__(self, tokenizer_path: str, make, fixed: dict | None = None, limit: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.make, self.limit, self.fixed = make, limit, dict(fixed or {})
        tokenize, letters = self.tokenizer.model.tokenize, _byte_letters()

        def one(word: str):
            if _rare(word):
                return make(self.tokenizer.encode(word, add_special_tokens=False).ids)
            if not (word.isascii() and word.isprintable()):
                word = word.encode().decode("latin-1").translate(letters)
            return make([t.id for t in tokenize(word)])

        self._one = one
        self.cache = _Cache(one, self.fixed)

    @property
    def misses(self) -> int:
        return self.cache.misses

    def chunk(self, texts: list[str]) -> list:
        """Per text the list of its pre-tokens' values."""
        if len(self.cache) > self.limit + len(self.fixed):
            young = _Cache(self._one, self.fixed)
            young.old, young.misses = dict(self.cache), self.cache.misses
            self.cache = young
        get = self.cache.__getitem__
        return [list(map(get, pretokens(t))) for t in texts]


def chunks(texts: list[str], most: int = 2_000_000):
    """Slices of a list whose texts have about `most` characters together (one text at least)."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]
