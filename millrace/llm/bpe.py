"""BPE encoding and decoding with exact merges in linear time.

A tokenizer file (the JSON of the `tokenizers` library, a BPE model with word
ends) is read on the driver and broadcast; its size is that of the vocabulary,
a few megabytes. Every Python worker builds a `BpeCodec` from it once.

Encoding a word works by backtracking over longest matches. One Aho-Corasick
pass over the reversed word gives, for each position, the longest token that
starts there. Tokens are put on a stack; a token may follow another only if the
merge rules, applied to the two together, would leave them as they are (the pair
table). Where the longest token doesn't fit, its next shorter prefix is tried;
where none fits, the position is marked dead and the token before it is taken
back. Since every prefix of a word has one valid encoding, each position is
entered once, and the work is linear in the length.

Which characters are letters, numbers and capitals is settled by Python's tables and,
for what Unicode 16 and 17 added to them, by the fixed values below, as the tokenizers
library settles it; the tables of `regex` are newer and aren't asked about those.

Defined results: a null text counts as empty and has no tokens, and an empty table
gives an empty result; texts of any length are encoded whole, and a word's tokens don't
depend on its place; the merge rules leave no ties; rows that are repeated are encoded
each; extra columns of the input are passed through by `encode_documents`, unless they
have the name of an output column, in which case the output column stands in their
place.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from string import ascii_letters

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Unicode white space as regular expressions of the tokenizer files mean it.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
# Letters and numbers added by Unicode 16, as (first, last), and capitals added since with their small letters.
_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {x: x + 0x20 for x in range(0x10D50, 0x10D66)} | {x: x + 0x1B for x in range(0x16EA0, 0x16EB9)}
_HAS_CAPITALS = re.compile(f"[{''.join(chr(x) for x in _CAPITALS if x < 0x10000)}]").search
# What lies beyond the first 65,536 characters is looked at one by one; below, a set finds the few that tables differ in.
_IS_BEYOND = re.compile("[\U00010000-\U0010ffff]").search
_HAS_LATE = re.compile(f"[{''.join(c for c in regex.findall(r'[\p{L}\p{N}]', ''.join(map(chr, range(0xD800)))) + regex.findall(r'[\p{L}\p{N}]', ''.join(map(chr, range(0xE000, 0x10000)))) if unicodedata.category(c) == 'Cn')}]").search
_END_SHIFT = 0x400  # a word's last symbol is another symbol than the same byte elsewhere
_CACHE_WORDS = 150_000  # in each of two generations
_ROWS = 256  # texts whose tokens are held at a time
_CACHE_CHARS = 40  # longer words are encoded each time
_PAIR_MEMO = 250_000
_CHUNKS = re.compile(f"[^{_SPACE}]+").findall


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(plain))
    return [out[b] for b in range(256)]


def _onig(pattern: str) -> str:
    """Pattern of a tokenizer file for `regex`, whose `\\s` differs."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]")


def _lower(text: str) -> str:
    """Lower case character by character: no final sigma."""
    if not text.isascii() and (_HAS_CAPITALS(text) or _IS_BEYOND(text)):
        text = text.translate(_CAPITALS)
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def _like(c: str) -> str:
    """A character of `c`'s class that all tables have, for one that Python's don't."""
    if unicodedata.category(c) != "Cn":
        return c
    x = ord(c)
    return "ª" if any(a <= x <= b for a, b in _LETTERS) else "0" if any(a <= x <= b for a, b in _NUMBERS) else "\ue000"


def _exact(find: regex.Pattern) -> Callable[[str], list[str]]:
    """All matches of a pattern, which sees characters that Python's tables don't have as others of their class."""

    def pieces(s: str) -> list[str]:
        if s.isascii() or not (_HAS_LATE(s) or _IS_BEYOND(s)):
            return find.findall(s)
        t = "".join(map(_like, s))
        return [s[m.start() : m.end()] for m in find.finditer(t)]

    return pieces


def _flat(part: dict | None, key: str) -> list[dict]:
    if not part:
        return []
    return [y for x in part[key] for y in _flat(x, key)] if part["type"] == "Sequence" else [part]


class BpeCodec:
    """Encoder and decoder for one tokenizer file's text."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        for k in ("dropout", "continuing_subword_prefix", "unk_token"):
            if model.get(k):
                raise ValueError(f"unsupported BPE setting: {k}")
        if model["type"] != "BPE" or d.get("decoder"):
            raise ValueError("only BPE models without a decoder are supported")
        self._steps = [self._normalizer(x) for x in _flat(d.get("normalizer"), "normalizers")]
        self._pieces = self._pre_tokenizer(_flat(d.get("pre_tokenizer"), "pretokenizers"))
        # Of ASCII words nothing is changed but capitals, and letters alone are one piece.
        self._lowers = any(x["type"] == "Lowercase" for x in _flat(d.get("normalizer"), "normalizers"))
        self._letters_whole = "[\\p{L}]+" in json.dumps(d["pre_tokenizer"]).replace("\\\\", "\\") and self._pieces(ascii_letters) == [ascii_letters]
        added = {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        if any(x.get("normalized") or x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in d.get("added_tokens", [])):
            raise ValueError("only plain added tokens are supported")
        self._added = added
        self._split_added = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self._symbols = {b: c for b, c in enumerate(byte_symbols())}
        self._load(model, added)
        self._cache: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    # -- tables -----------------------------------------------------------
    @staticmethod
    def _normalizer(x: dict) -> Callable[[str], str]:
        if x["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
            form = x["type"]
            return lambda s: s if s.isascii() else unicodedata.normalize(form, s)
        if x["type"] == "Lowercase":
            return _lower
        if x["type"] == "Replace":
            p = x["pattern"]
            if p != {"Regex": r"\s+"} or x["content"] != " ":
                raise ValueError("only white space can be replaced, by one space")
            return lambda s: s  # white space only parts the words: see `encode`
        raise ValueError(f"unsupported normalizer: {x['type']}")

    @staticmethod
    def _pre_tokenizer(parts: list[dict]) -> Callable[[str], list[str]]:
        if [x["type"] for x in parts] != ["Split", "ByteLevel"]:
            raise ValueError("the pre-tokenizer must be a split into matches, then byte level")
        split, byte = parts
        if split["behavior"] != "Removed" or not split["invert"] or byte["use_regex"] or byte["add_prefix_space"]:
            raise ValueError("unsupported pre-tokenizer settings")
        find = _exact(regex.compile(_onig(split["pattern"]["Regex"])))
        # Words can be split one by one if no match holds or looks at white space.
        if re.search(r"\(\?|[\^$](?![^\[]*\])|\\b", split["pattern"]["Regex"]) or any(find(x) for x in " \t\n\x0b\x0c\r\x85\xa0\u2003\u3000"):
            raise ValueError("unsupported split pattern")
        return find

    def _load(self, model: dict, added: dict[str, int]) -> None:
        end = model.get("end_of_word_suffix") or ""

        def symbols(token: str) -> str:
            if end and token.endswith(end):
                token = token[: -len(end)]
                return token[:-1] + chr(ord(token[-1]) + _END_SHIFT)
            return token

        vocab = model["vocab"]
        ids = {symbols(t): i for t, i in vocab.items()}
        self._has_end = bool(end)
        size = max([*vocab.values(), *added.values()]) + 1
        rank, parts = [-1] * size, [(-1, -1)] * size
        merges: dict[tuple[int, int], int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, t = (vocab[a], vocab[b]), vocab[a + b]
            if rank[t] >= 0 or k <= max(rank[pair[0]], rank[pair[1]]):
                raise ValueError("every token must have one merge, after those of its parts")
            merges[pair], rank[t], parts[t] = k, k, pair
        self._rank, self._parts, self._merges = rank, parts, merges
        self._pairs: dict[tuple[int, int], bool] = {}
        # A token that the merges never leave whole is never part of a result.
        whole = [False] * size
        for s, t in sorted(ids.items(), key=lambda x: rank[x[1]]):
            a, b = parts[t]
            whole[t] = len(s) == 1 or (a >= 0 and whole[a] and whole[b] and self._untouched(a, b))
        usable = {s: t for s, t in ids.items() if whole[t]}
        self._usable = usable
        self._length = [0] * size
        self._shorter = [-1] * size
        self._atoms = {s: t for s, t in usable.items() if len(s) == 1}
        find = ahocorasick.Automaton()
        for s, t in usable.items():
            self._length[t] = len(s)
            for n in range(len(s) - 1, 0, -1):
                if (p := usable.get(s[:n])) is not None:
                    self._shorter[t] = p
                    break
            find.add_word(s[::-1], t)
        find.make_automaton()
        self._find = find
        # Decoding: token i is what stands between offsets i and i + 1.
        names = [""] * size
        for s, i in [*vocab.items(), *added.items()]:
            names[i] = s
        self._names, self._offsets = "".join(names), [0]
        for s in names:
            self._offsets.append(self._offsets[-1] + len(s))
        self._cut = [self._names[a:b] for a, b in zip(self._offsets, self._offsets[1:])]  # each token cut out once
        self._decimal = [str(i) for i in range(size)]

    # -- pair table -------------------------------------------------------
    def _untouched(self, left: int, right: int) -> bool:
        """No merge across the border comes before those that make the two tokens.

        The merges that made both are taken back, the latest first. While the next
        merge to come has rank k, one across the border would come before it with a
        lower rank, or with the same rank if it stands further left.
        """
        rank, parts, merges = self._rank, self._parts, self._merges
        while True:
            x, y = rank[left], rank[right]
            if x < 0 and y < 0:
                return True
            if y >= x:  # of equal merges the left one comes first, so the right one is the latest
                right, limit = parts[right][0], y + 1
            else:
                left, limit = parts[left][1], x
            across = merges.get((left, right))
            if across is not None and across < limit:
                return False

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens, side by side, as they are."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= _PAIR_MEMO:
                self._pairs.clear()
            known = self._pairs[key] = key not in self._merges and self._untouched(left, right)
        return known

    # -- encoding ---------------------------------------------------------
    def _word(self, piece: str) -> list[int]:
        s = piece if piece.isascii() and piece.isalpha() else piece.encode("utf-8").decode("latin-1").translate(self._symbols)
        if self._has_end:
            s = s[:-1] + chr(ord(s[-1]) + _END_SHIFT)
        if (token := self._usable.get(s)) is not None:
            return [token]
        n = last = len(s)
        last -= 1
        length, shorter, pairs, compatible = self._length, self._shorter, self._pairs, self.compatible
        # The longest match of an end comes first, so that it is what stays in the dict.
        longest = dict([*self._find.iter(s[::-1])][::-1])
        if len(longest) < n:
            raise ValueError("the vocabulary lacks a byte")
        dead: set[int] = set()
        out: list[int] = []
        pos, token, before = 0, longest[last], -1
        while pos < n:
            while token >= 0:
                if not dead or pos + length[token] not in dead:
                    if before < 0:
                        break
                    fits = pairs.get((before, token))
                    if compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length[token]
                before = token
                if pos < n:
                    token = longest[last - pos]
            else:
                dead.add(pos)
                token = out.pop()
                before = out[-1] if out else -1
                pos -= length[token]
        return out

    def _chunk(self, raw: str) -> tuple[int, ...]:
        got = self._older.get(raw)
        if got is None:
            s = raw
            if raw.isascii():
                s = raw.lower() if self._lowers else raw
            else:
                for step in self._steps:
                    s = step(s)
            if self._letters_whole and s.isascii() and s.isalpha():
                got = tuple(self._word(s))
            else:
                got = tuple([i for p in self._pieces(s) for i in self._word(p)])
        if len(raw) <= _CACHE_CHARS:
            if len(self._cache) >= _CACHE_WORDS:
                self._older, self._cache = self._cache, {}
            self._cache[raw] = got
        return got

    def encode(self, text: str | None) -> Encoded:
        """Tokens of a whole text; special tokens in it stand for themselves."""
        ids: list[int] = []
        chunk = self._chunk
        at, text = 0, text or ""
        spots = [*self._split_added.finditer(text), None] if self._split_added else [None]
        for m in spots:
            part = text[at : m.start()] if m else text[at:]
            get = self._cache.get
            for w in _CHUNKS(part):
                ids += get(w) or chunk(w)
            if m:
                ids.append(self._added[m[0]])
                at = m.end()
        return Encoded(self, ids)

    def decode(self, ids) -> str:
        """Text of token ids: the tokens of the offset table, joined by spaces."""
        return " ".join(map(self._cut.__getitem__, ids))


class Encoded:
    """Tokens of one text."""

    __slots__ = ("_codec", "ids")

    def __init__(self, codec: BpeCodec, ids: list[int]):
        self._codec, self.ids = codec, ids

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def ids_text(self) -> str:
        """The decimal ids, joined by one space."""
        return " ".join(map(self._codec._decimal.__getitem__, self.ids))

    @property
    def decoded(self) -> str:
        """What decoding the ids gives."""
        return self._codec.decode(self.ids)


_codecs: dict[int, BpeCodec] = {}


def codec(spec: str) -> BpeCodec:
    """The codec of a tokenizer file's text, built once in each process."""
    key = hash(spec)
    if key not in _codecs:
        _codecs[key] = BpeCodec(spec)
    return _codecs[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def map_encoded(df: DataFrame, spec: str, make: Callable[[Encoded], tuple], made: T.StructType, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode `text` of every row; `make` turns the tokens into the columns `made`.

    `spec` is a tokenizer file's text. `keep` names the input columns to pass
    through (all by default). What `make` leaves out never leaves the executor.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in made}]
    shared = df.sparkSession.sparkContext.broadcast(spec)
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], *made.fields])
    names = [f.name for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        c = codec(shared.value)
        kinds = [to_arrow_type(f.dataType) for f in made]
        for b in (x.slice(i, _ROWS) for x in batches for i in range(0, x.num_rows, _ROWS)):
            rows = [make(c.encode(t.as_py())) for t in b.column(b.num_columns - 1)]
            new = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*keep, *names])

    inputs = [df[f"`{c}`"] for c in keep] + [df[f"`{text}`"].cast("string").alias("_text")]
    return df.select(inputs).mapInArrow(run, schema)


def encode_documents(df: DataFrame, spec: str, *, text: str = "text", keep: list[str] | None = None, decoded: bool = True) -> DataFrame:
    """Adds `token_ids` (array of int), `n_tokens` (long) and, if wanted, `decoded` (string)."""
    made = T.StructType().add("token_ids", T.ArrayType(T.IntegerType(), False)).add("n_tokens", T.LongType())
    if decoded:
        return map_encoded(df, spec, lambda e: (e.ids, len(e), e.decoded), made.add("decoded", T.StringType()), text=text, keep=keep)
    return map_encoded(df, spec, lambda e: (e.ids, len(e)), made, text=text, keep=keep)
