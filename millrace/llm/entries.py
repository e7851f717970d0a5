"""Typed values mapped to the entries of a reference list: a trie of entries and aliases, searched with Levenshtein automata."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that introduce or qualify an entry; no candidate starts or ends with one. Fixed values.
QUALIFIERS = frozenset(
    "a an the and or of in with for from to on at as is use using used daily good strong solid proven sound deep broad basic advanced expert excellent practical hands-on hands working experience experienced exp exp. knowledge skill skills "
    "background training level certified certification ideally must know knows should have nice similar equivalent some any years year yrs yr months plus preferred required optional desired familiar familiarity understanding expertise "
    "competence ability kenntnisse erfahrung mit und oder gute sehr conocimientos experiencia de en con del la el y connaissances expérience avec des du le et maîtrise conhecimentos experiência em com esperienza conoscenza di".split()
)


def squashed(text: str) -> str:
    """text in lower case without accents' composition, spaces and punctuation but '+' and '#': the spelling a path is made of."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum() or c in "+#")


def allowance(length: int) -> int:
    """The edits allowed for a path of this length: none up to 4 characters, 1 up to 6, 2 up to 12, then 3."""
    return 0 if length <= 4 else 1 if length <= 6 else 2 if length <= 12 else 3


MOST_EDITS = 3


class Trie:
    """Paths to entry ids. A node has its children, its ids, and the fewest and most characters from here to an end."""

    def __init__(self) -> None:
        self.root: tuple[dict, list, list] = ({}, [], [1 << 30, 0])

    def add(self, path: str, entry: int) -> None:
        node = self.root
        for i, c in enumerate(path):
            node[2][:] = min(node[2][0], len(path) - i), max(node[2][1], len(path) - i)
            node = node[0].setdefault(c, ({}, [], [1 << 30, 0]))
        node[2][0] = 0
        if entry not in node[1]:
            node[1].append(entry)

    def find(self, path: str) -> tuple[dict, list, list] | None:
        node = self.root
        for c in path:
            node = node[0].get(c)
            if node is None:
                return None
        return node

    def search(self, query: str, most: int) -> dict[int, tuple[int, int]]:
        """entry id -> (edits, path length), the fewest edits of its paths, for all entries with a path that needs no more
        than `most` edits and no more than allowance(path length). An edit inserts, drops or changes a character or swaps two neighbours.

        The automaton of the query is run along the trie's paths: bit i of state d means that i characters of the query are
        read with d edits; of swap d, that the swap's first character is read. A branch ends where no bit is left.
        """
        n = len(query)
        full, end = (1 << (n + 1)) - 1, 1 << n
        masks: dict[str, int] = {}
        for i, c in enumerate(query):
            masks[c] = masks.get(c, 0) | 1 << i
        found: dict[int, tuple[int, int]] = {}
        stack = [(self.root, 0, tuple((1 << (d + 1)) - 1 & full for d in range(most + 1)), (0,) * (most + 1))]
        while stack:
            node, depth, state, swap = stack.pop()
            if node[1]:
                for d, bits in enumerate(state):
                    if bits & end:
                        if d <= allowance(depth):
                            for e in node[1]:
                                if e not in found or d < found[e][0]:
                                    found[e] = (d, depth)
                        break
            for c, child in node[0].items():
                if depth + 1 + child[2][0] > n + most or depth + 1 + child[2][1] < n - most:
                    continue
                m = masks.get(c, 0)
                row = (state[0] & m) << 1 & full
                new, new_swap, any_ = [row], [0], row
                for d in range(1, most + 1):
                    before = state[d - 1]
                    row = ((state[d] & m) << 1 | before | before << 1 | new[d - 1] << 1 | (swap[d] & m) << 2) & full
                    new.append(row)
                    s = before & (m >> 1)
                    new_swap.append(s)
                    any_ |= row | s
                if any_:
                    stack.append((child, depth + 1, tuple(new), tuple(new_swap)))
        return found


class Matcher:
    """Maps a typed value to an entry; remembers what it has seen, up to `remembered` values."""

    def __init__(self, entries: Iterable[tuple[int, str, Sequence[str]]], remembered: int = 200_000):
        self.trie, self.words, self.remembered = Trie(), {}, remembered
        for entry, name, aliases in entries:
            words = name.lower().split()
            self.words[entry] = words
            self.trie.add(squashed(name), entry)
            for alias in aliases or ():
                if alias and squashed(alias):
                    self.trie.add(squashed(alias), entry)
            for i in range(1, len(words)):  # words turned round: "balancing, shard", "balancing of shards"
                turned = words[i:] + words[:i]
                self.trie.add(squashed("".join(turned)), entry)
                self.trie.add(squashed("".join(words[i:]) + "of" + "".join(words[:i])), entry)
        self.most_words = max((len(w) for w in self.words.values()), default=1) + 1
        self.listed = sorted((words, entry) for entry, words in self.words.items())
        self.known: dict[str, int] = {}
        self.windows: dict[str, list[tuple[int, int, int]]] = {}

    def candidates(self, window: str) -> list[tuple[int, int, int]]:
        """(entry, edits, path length) of all entries within the distance of a squashed text."""
        got = self.windows.get(window)
        if got is None:
            most = max(d for d in range(MOST_EDITS + 1) if d <= allowance(len(window) + d))  # a path d edits away has at most d characters more
            got = [(e, d, n) for e, (d, n) in self.trie.search(window, most).items()]
            if len(self.windows) >= self.remembered:
                self.windows.clear()
            self.windows[window] = got
        return got

    def match(self, value: str) -> int:
        """The entry's id, -1 if the value means none."""
        got = self.known.get(value)
        if got is None:
            got = self._match(value)
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[value] = got
        return got

    def _match(self, value: str) -> int:
        exact = self.trie.find(squashed(value))
        if exact and exact[1]:
            return min(exact[1])
        text = unicodedata.normalize("NFKC", value).lower()
        tokens = [t for t in re.split(r"[\s/_,;:&|()\[\]{}\"“”«»!?*]+", text) if t.strip(".-'–—•")]
        best = None
        for i in range(len(tokens)):
            if tokens[i] in QUALIFIERS:
                continue
            for j in range(i + 1, min(len(tokens), i + self.most_words + 1) + 1):
                if tokens[j - 1] in QUALIFIERS:
                    continue
                window = squashed("".join(tokens[i:j]))
                if len(window) < 3:
                    continue
                for entry, edits, length in self.candidates(window):
                    score = (length - 2.0 * edits, -edits, -abs(len(window) - length), -entry)
                    if best is None or score > best[0]:
                        best = (score, entry)
        if best:
            return best[1]
        return self._shortened(tokens)

    def _shortened(self, tokens: list[str]) -> int:
        """The entry of which some words are cut short with a full stop ("banner rotat."), if they fit one entry or all its longer forms."""
        if not any(t.endswith(".") for t in tokens):
            return -1
        fits = []
        for i, token in enumerate(tokens):
            start = token[:-1] if token.endswith(".") and len(token) > 2 else token
            for words, entry in self.listed[bisect_left(self.listed, ([start],)) :]:  # those whose first word starts so stand together
                if not words[0].startswith(start):
                    break
                part = tokens[i : i + len(words)]
                if len(part) == len(words) and any(t.endswith(".") for t in part) and all(t == w or t.endswith(".") and len(t) > 2 and w.startswith(t[:-1]) for t, w in zip(part, words)):
                    fits.append((len("".join(words)), entry))
        fits.sort()
        if not fits:
            return -1
        first = "".join(self.words[fits[0][1]])
        return fits[0][1] if all("".join(self.words[e]).startswith(first) for _, e in fits) else -1


def map_values(df: DataFrame, key: str, fields: Sequence[str], entries: DataFrame, most_entries: int = 100_000, salts: int = 8) -> DataFrame:
    """(key, field_name, pos, value, skill_id): every element of the array columns that isn't null or blank, with the entry it means, -1 for none.

    entries: skill_id, canonical, variants. The list must be small by nature, as each worker holds its trie; more than most_entries
    are refused, not cut. Values are made distinct over the whole table before they are searched, each once, and the entries joined
    back by value, salted, as a third of all rows may hold one value. Of entries that fit equally well the lowest id holds. Null
    and empty arrays give no rows, repeated rows theirs each. An empty list maps all to -1.
    """
    rows = entries.select("skill_id", "canonical", "variants").filter(F.col("canonical").isNotNull()).orderBy("skill_id").limit(most_entries + 1).collect()
    if len(rows) > most_entries:
        raise ValueError(f"the reference list has more than {most_entries} entries")
    listed = [(r[0], r[1], list(r[2] or ())) for r in rows]
    matcher = [None]
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("vs")) for f in fields]))
    flat = df.select(F.col(key).alias("_key"), named.alias("_f")).select("_key", "_f.field_name", F.posexplode("_f.vs").alias("pos", "value")).filter(F.col("value").rlike(r"(?U)[^\s\x{200B}\x{FEFF}]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if matcher[0] is None:
            matcher[0] = Matcher(listed)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([matcher[0].match(v) for v in b.column(0).to_pylist()], pa.int32())], ["value", "skill_id"])

    spread = df.sparkSession.sparkContext.defaultParallelism * 3  # the values are few bytes but much work: not to be coalesced by size
    meant = flat.select("value").distinct().repartition(spread).mapInArrow(run, "value string, skill_id int").withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    salted = flat.withColumn("_salt", F.pmod(F.xxhash64("_key", "field_name", "pos"), F.lit(salts)).cast("int"))
    return salted.join(meant, ["value", "_salt"]).select(F.col("_key").alias(key), "field_name", "pos", "value", "skill_id")


def unlisted(mapped: DataFrame) -> DataFrame:
    """(value, n): the values that mean no entry, with the number of times they were typed."""
    return mapped.filter("skill_id = -1").groupBy("value").agg(F.count("*").alias("n"))
