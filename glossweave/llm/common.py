"""Pieces the operators share: words, word numbers, token ids, and numbering over partitions."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Words are runs of characters other than these, with A-Z lower-cased.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(column, modulus: int):
    """Remainder of the CRC of the id as text; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def words(text: str | None) -> list[bytes]:
    """ASCII white space splits, ASCII letters are folded; anything else is left alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordNumbers(dict):
    """64-bit number of a word, remembered for at most ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        n = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = n
        return n

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit multiply-xorshift hash (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_numbers(numbers: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct numbers of all runs of ``size`` words; one for a shorter, non-empty sequence."""
    n = len(numbers)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    out = mix(numbers[: n - size + 1] + np.uint64(size))
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + numbers[k : n - size + 1 + k])
    return np.unique(out)


#: Marks behind a word that are one token group of their own (no apostrophes, which can begin a suffix).
MARKS = ".,;:!?%&*#$|()[]{}\"-+=/_~^<>@"

#: Letters of Latin-1 only: their normal form is themselves.
PLAIN = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]+"
LETTERS = "".join(re.findall(PLAIN, "".join(map(chr, range(256)))))

#: Characters that may count as white space, and zero, which marks pieces to be read as they are.
WHITE = r"[\s\x00\x0B\x1C-\x1F\x{85}\p{Z}]"

#: White space at an end of a text, or beside a space or line feed; or a zero anywhere.
RUNS = rf"\A{WHITE}|{WHITE}\z|{WHITE}[ \n]|[ \n]{WHITE}|\x00"

_encoders: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """Token ids of whole texts, through the tokenizers library.

    A text is cut where no token of the vocabulary can reach across, at single
    spaces and line feeds, and every distinct piece is encoded once by the
    library; texts become ids again by gathering from the ids of their pieces. A
    Python worker forgets its pieces when it knows more than ``most`` of them and
    then encodes them again. The ids are those of the whole text.

    A piece stands for itself after one space (or, where the tokenizer drops white
    space, for itself alone); one after a line feed begins with it, and one to be
    read as it is with a zero. Marks behind a word are pieces of their own.

    With ``added`` the added tokens of the vocabulary that a text spells out, such
    as '<|endoftext|>', have their own ids, as the library gives them by default;
    a text that may hold one goes to the library whole. Without, they are text.
    """

    def __init__(self, path: str, most: int = 800_000, added: bool = False):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        # The signs such a token begins with; normal forms and folding change letters, so one that begins with a letter leaves no sign.
        begins = {"".join(itertools.takewhile(lambda c: c.isascii() and not c.isalnum() and not c.isspace(), t.content)) for t in self.lib.get_added_tokens_decoder().values()} if added else set()
        self.begins = "|".join(map(re.escape, sorted(begins))) if begins else None
        # A tokenizer that drops white space needs no leading space in front of a piece.
        self.keeps_space = bool(self.lib.encode(" \n", add_special_tokens=False).ids)
        # Tokens that begin a word with its space, or else end a word: they part the words of a long text again.
        names = [self.lib.id_to_token(i) or "" for i in range(self.lib.get_vocab_size())]
        self.edge = np.array([n.startswith("Ġ") if self.keeps_space else n.endswith("</w>") for n in names])
        feed = self.lib.encode("\n", add_special_tokens=False).ids
        self.feed = np.arange(len(names)) == (feed[0] if len(feed) == 1 else -1)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {"": 0}
        self.tails: dict[str, int] = {"": 0}
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        # Number 0 is a piece without ids.
        self.used, self.known = 0, 1

    def pieces(self, text: str) -> list[str]:
        """Keys of the pieces of any text where spaces are kept: white space in runs belongs together."""
        parts, joined, glue = text.split(" "), [], True
        for p in parts:
            if not joined:
                joined.append(p)
            elif glue or not p or p[0].isspace():
                joined[-1] += " " + p
            else:
                joined.append(" " + p)
            glue = not p or p[-1].isspace()
        # A lone space before a word is what a key stands for; everything else is read as it is.
        return ["", "\n", *(p[1:] if p[:1] == " " and p[1:2] not in ("", " ", "\n", "\0") else "\0" + p for p in joined)]

    def text(self, key: str) -> str:
        """What the library is given for a key."""
        if not self.keeps_space or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == "\0" else " " + key

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Keys of all pieces of all texts, and the place where each text begins (and the end)."""
        if not self.keeps_space:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            return lists.flatten(), np.asarray(lists.offsets)
        # A line feed in front is no part of the text: its id is left out later.
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n"), " ")
        loose = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, RUNS)))
        if not len(loose):
            return lists.flatten(), np.asarray(lists.offsets)
        chunks, sizes, last = [], np.diff(np.asarray(lists.offsets)).astype(np.int64), 0
        for i in loose.tolist():
            own = pa.array(self.pieces(texts[i].as_py()), pa.string())
            chunks += [lists.slice(last, i - last).flatten(), own]
            sizes[i], last = len(own), i + 1
        chunks.append(lists.slice(last).flatten())
        return pa.concat_arrays(chunks), np.concatenate(([0], np.cumsum(sizes)))

    def gathered(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The runs of ids, one behind another."""
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        if len(self.numbers) > self.most:
            self.forget()
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, self.begins))).tolist() if self.begins else []
        spelled = {i: texts[i].as_py() for i in odd}
        if odd:
            texts = pc.if_else(pc.match_substring_regex(texts, self.begins), "", texts)
        keys, begins = self.cut(texts)
        keys = keys.dictionary_encode()
        at = np.asarray(keys.indices)
        first, second = self.known_pieces(keys.dictionary)
        # Ids of each distinct piece: word, then the marks behind it.
        both = np.stack([first, second], 1).ravel()
        own = self.gathered(self.ids, self.starts[both], self.sizes[both])
        sizes = self.sizes[first] + self.sizes[second]
        starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[at]
        sizes = sizes[at].astype(np.int64)
        if self.keeps_space:
            lead = begins[:-1] + 1
            starts[lead] += 1
            sizes[lead] -= 1
        data = self.gathered(own, starts, sizes).astype("<u4", copy=False).tobytes()
        ends = (np.concatenate(([0], np.cumsum(sizes)))[begins] * 4).tolist()
        out = [data[a:b] for a, b in itertools.pairwise(ends)]
        if spelled:
            # One copy of the vocabulary reads added tokens either way.
            self.lib.encode_special_tokens = False
            for i, text in spelled.items():
                out[i] = np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            self.lib.encode_special_tokens = True
        return out

    def known_pieces(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of each key's word and of the marks behind it; new ones are learnt."""
        cores = pc.utf8_rtrim(keys, MARKS)
        plain = pc.match_substring_regex(cores, rf"\A\n?{PLAIN}\z")
        names = pc.if_else(plain, cores, keys).dictionary_encode()
        plain, words = np.asarray(plain), names.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.numbers.get, words, itertools.repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(numbers < 0).tolist()
        if fresh:
            simple = np.zeros(len(words), bool)
            simple[np.asarray(names.indices)[plain]] = True
            groups: tuple[list[str], list[str], list[str]] = ([], [], [])
            for i in fresh:
                groups[2 if not simple[i] else words[i][0] == "\n"].append(words[i])
            self.learn(*groups)
            numbers[fresh] = np.fromiter(map(self.numbers.__getitem__, [words[i] for i in fresh]), np.int64, len(fresh))
        # Only words have marks of their own behind them.
        marked = plain & (np.asarray(pc.binary_length(keys)) > np.asarray(pc.binary_length(cores)))
        tails = pc.utf8_ltrim(keys.filter(pa.array(marked)), "\n" + LETTERS).dictionary_encode()
        named = tails.dictionary.to_pylist()
        if new := [t for t in named if t not in self.tails]:
            self.singly(self.tails, new, new)
        second = np.zeros(len(keys), np.int64)
        second[marked] = np.array([self.tails[t] for t in named], np.int64)[np.asarray(tails.indices)]
        return numbers[np.asarray(names.indices)], second

    def learn(self, spaced: list[str], fed: list[str], other: list[str]) -> None:
        """Encodes new pieces: plain words many in one text, others singly."""
        for words, glue, edge in ((spaced, " ", self.edge), (fed, "", self.feed)):
            for i in range(0, len(words), 2000):
                part = words[i : i + 2000]
                whole = (glue if self.keeps_space else "") + glue.join(part)
                ids = np.array(self.lib.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint32)
                at = np.flatnonzero(edge[ids])
                if len(at) != len(part):
                    other.extend(part)
                    continue
                self.keep(self.numbers, part, ids, np.diff(np.append(at, len(ids)) if self.keeps_space else np.append(-1, at)))
        if other:
            self.singly(self.numbers, other, [self.text(k) for k in other])

    def singly(self, names: dict[str, int], keys: list[str], texts: list[str]) -> None:
        found = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.keep(names, keys, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def keep(self, names: dict[str, int], keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        used, known = self.used + len(ids), self.known + len(keys)
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        if known > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * known), np.resize(self.sizes, 2 * known)
        self.ids[self.used : used] = ids
        self.starts[self.known : known] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.known : known] = sizes
        names.update(zip(keys, range(self.known, known)))
        self.used, self.known = used, known


def encoder(path: str, added: bool = False, most: int = 800_000) -> Encoder:
    """One encoder per Python worker, vocabulary and reading of added tokens; it remembers at most about ``most`` pieces."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added=added)
    _encoders[path, added].most = most
    return _encoders[path, added]


def slices(batch: pa.RecordBatch, column: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about this many bytes of text each, at least one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= chars:
            ends.append(i + 1)
            total = 0
    if not ends or ends[-1] < len(sizes):
        ends.append(len(sizes))
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def offsets(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all smaller keys, for one row per partition of a job (never per document)."""
    return counts.groupBy(key).agg(F.sum(value).alias("_n")).select(
        key, (F.sum("_n").over(Window.orderBy(key)) - F.col("_n")).alias(name)
    )
