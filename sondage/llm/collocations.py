"""Collocations: phrases whose words occur together far more often than apart, ranked by language.

Texts (A-Z lower-cased) are split at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs into words. All phrases of one to
``longest`` words of a piece become rows and are counted by language. A candidate has two words or more and occurs ``fewest`` times. Cut after its
first k words, its score is floor(1000000 a a / (l r)), with a, l and r the counts of the phrase and of its two parts; the cut with the lowest
score counts, of several the shortest first part. A candidate goes if a longer one holds its words, in order and without a gap, and
occurs at least half as often. Of each language the ``most`` best stay.

Counting goes in two passes, as most phrases are rare and their texts would be most of what is shuffled. The first counts words by their texts. A frequent phrase has frequent words only, so these are numbered and sent
to all tasks, and the second pass counts phrases as the numbers of their words in one integer: exact, and a text is made for frequent phrases only. In both a task adds up what it has read before it hands on rows.
Languages whose frequent words are too many to be sent together are counted in passes of their own. Where the words of a single language are too many, or the numbers of a phrase exceed an integer, its phrases are found by
hash: the first pass sums hashes, cut to 32 bits and more the more text there is, the second counts the phrases themselves whose hash is frequent. A shared hash lets a rare phrase into the second pass, where it is counted as it is, so these
counts are exact too. If too many hashes are frequent to be sent to all tasks, all phrases are counted by their texts. A longer candidate
that holds a shorter one is found by one-word extensions: what lies between the two occurs at least as often as the longer.

Products are decimals of 38 digits: exact for counts below ten to the power of 14. Ranks are taken in parts of a language first, so that no task sorts all candidates of a language.

Defined cases: null and empty texts have no words; a null language is ``und``, together with rows of that name; each of several equal rows counts; ties of score and count are ordered
by phrase in byte order; extra columns are ignored; an empty table gives an empty result. Columns ``text`` and ``lang`` are read as strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm.common import BROADCAST_IDS, Staging, small_batches
from sondage.llm.words import mix, slices, span_hashes

UNKNOWN = "und"
FEWEST, LONGEST, MOST = 10, 3, 2000
#: A longer candidate that occurs this often, in percent, makes a shorter one inside it superfluous.
COVERED = 50
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Hashes of phrases that a task holds before it adds them up.
HELD = 1_000_000
#: Bits of a hash inside a range of hashes, and about how many phrases a range holds.
RANGE_BITS, RANGE_PHRASES = 32, 1_000_000
#: Texts whose words are numbered at once.
TEXT_BYTES = 8 << 20
#: Bits of an integer that holds the numbers of a phrase's words.
KEY_BITS = 63
#: A task hands on what it holds after so many phrases, or so many different ones; rows that are handed on at once.
MOST_MET, MOST_NAMES, AT_ONCE = 3_000_000, 250_000, 65_536

_COUNT = "decimal(14,0)"
#: What each byte is: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
#: Small letters, and a full stop between pieces.
_PLAIN = bytes(46 if _KIND[x] == 2 else x for x in bytes(range(256)).lower())


class Phrases:
    """The words of a slice of texts with two hashes each, and their phrases: ``hashes(k)`` of k words from each place that has so many in its piece."""

    def __init__(self, texts: list[bytes], langs: np.ndarray) -> None:
        self.joined = (b"\n".join(texts) + b"\n").lower()
        raw = np.frombuffer(self.joined, np.uint8)
        kind = _KIND[raw]
        edge = np.flatnonzero(np.diff((kind > 0).view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        breaks = np.concatenate(([0], np.cumsum(kind == 2)))
        self.piece = breaks[self.start]
        self.text = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), self.start, "right")
        lang = langs[self.text]
        self.words = [mix(h ^ lang) for h in span_hashes(raw, self.start, self.end, (0, 1))]

    def places(self, k: int) -> np.ndarray:
        return np.flatnonzero(self.piece[k - 1 :] == self.piece[: len(self.piece) - k + 1])

    def hashes(self, k: int, places: np.ndarray, which: int = 0) -> np.ndarray:
        out = self.words[which][places]
        for j in range(1, k):
            out = mix(out * np.uint64(3) + self.words[which][places + j])
        return out

    def phrase(self, place: int, k: int) -> str:
        return b" ".join(self.joined[self.start[place] : self.end[place + k - 1]].split()).decode()


def _read(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Phrases, list[str]]]:
    """(phrases, language of each text) of the slices of the batches."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        for first, held in slices(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")):
            own = langs[first : first + len(held)]
            yield Phrases(held, np.array([known[x] for x in own], np.uint64)), own


def _ranges(phrases: float) -> int:
    """Bits that tell ranges of about ``RANGE_PHRASES`` phrases each."""
    return int(phrases / RANGE_PHRASES).bit_length()


def _counted(docs: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]], bits: int, ranges: int, fewest: int, give: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``give`` makes of the keys, of ``bits`` bits spread evenly, that are met ``fewest`` times or more, and of their counts; ``keys`` yields those of each slice of the texts.

    Tasks send packed counts by range of keys: a row holds those of a range, as differences in order.
    """
    below, parts = np.uint64(bits - ranges), docs.sparkSession.sparkContext.defaultParallelism
    names = ["part", "low", "n"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            found, n = _summed(np.concatenate(held))
            held.clear()
            part = (found >> below).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            low, n = np.diff(found, prepend=np.uint64(0)), n.astype("<u4")
            low[first] = found[first]
            ends = list(zip(first.tolist(), [*first[1:].tolist(), len(found)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), *(pa.array([_planes(x[a:b]) for a, b in ends], pa.binary()) for x in (low, n))], names)

        for found in keys(batches):
            held += found
            if sum(map(len, held)) >= HELD:
                yield from out()
        if any(map(len, held)):
            yield from out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts, size = None, [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate(held), np.concatenate(counts))

        def out() -> Iterator[pa.RecordBatch]:
            found, n = merged()
            often = n >= fewest
            if often.any():
                yield give(found[often], n[often])

        for batch in batches:
            for part, low, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if part != now:
                    if now is not None:
                        yield from out()
                    now, held, counts, size = part, [], [], 0
                held.append(np.cumsum(_from_planes(low, "<u8"), dtype=np.uint64))
                counts.append(_from_planes(n, "<u4").astype(np.int64))
                size += len(held[-1])
                # What is held grows with the different keys of a range, not with the messages.
                if size > 2 * HELD and size > 2 * len(held[0]):
                    found, n = merged()
                    held, counts, size = [found], [n], len(found)
        if now is not None:
            yield from out()

    sent = _read(docs).mapInArrow(add, "part long, low binary, n binary")
    sent = sent.repartition(max(parts, 1 << max(0, ranges - 3)), "part").sortWithinPartitions("part")
    return sent.mapInArrow(total, schema)


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: small numbers leave zeros, which the shuffle compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(x: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).ravel()


def frequent_hashes(docs: DataFrame, fewest: int, longest: int) -> tuple[DataFrame, int]:
    """(hash) of the phrases that occur ``fewest`` times or more, and how many of the last bits of hashes are left out; rare phrases that share a hash may be among them."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = _ranges(size * longest / 6)
    shift = np.uint64(64 - ranges - RANGE_BITS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for phrases, _ in _each_slice(batches):
            yield [phrases.hashes(k, phrases.places(k)) >> shift for k in range(1, longest + 1)]

    def give(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["hash"])

    return _counted(docs, keys, RANGE_BITS + ranges, ranges, fewest, give, "hash long"), int(shift)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there, or the sums of its counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.diff(first, append=len(keys))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


class Counts:
    """Counts of phrases that a task has met: those of known hashes by the hash's number, others by their text."""

    def __init__(self, only: np.ndarray | None, shift: int = 0) -> None:
        self.only, self.shift = only, np.uint64(shift)
        self.texts: dict[tuple[str, str, int], int] = {}
        size = 0 if only is None else len(only)
        self.count, self.check, self.seen = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, bool)
        self.names: list[tuple[int, str, str, int]] = []
        self.held: list[np.ndarray] = []
        self.met = 0

    def add(self, phrases: Phrases, langs: list[str], longest: int) -> None:
        for i, n in enumerate(np.bincount(phrases.text, minlength=len(langs)).tolist()):
            self._by_text(langs[i], "", 0, n)
        for k in range(1, longest + 1):
            places = phrases.places(k)
            hashes = phrases.hashes(k, places)
            self.met += len(places)
            if self.only is None:
                other = phrases.hashes(k, places, 1)
                order = np.lexsort((other, hashes))
                first = np.flatnonzero(np.append(True, (np.diff(hashes[order]) != 0) | (np.diff(other[order]) != 0))) if len(order) else order
                for at, n in zip(places[order[first]].tolist(), np.diff(first, append=len(order)).tolist(), strict=True):
                    self._by_text(langs[phrases.text[at]], phrases.phrase(at, k), k, n)
            elif len(self.only):
                short = hashes >> self.shift
                # In order, as a search then finds what it needs next in the cache.
                order = np.argsort(short)
                short, places = short[order], places[order]
                at = np.searchsorted(self.only, short)
                at[at == len(self.only)] = 0
                take = self.only[at] == short
                self._known(phrases, langs, k, places[take], at[take])

    def _known(self, phrases: Phrases, langs: list[str], k: int, places: np.ndarray, at: np.ndarray) -> None:
        other = phrases.hashes(k, places, 1)
        new = np.flatnonzero(~self.seen[at])
        fresh, first = np.unique(at[new], return_index=True)
        first = new[first]
        self.seen[fresh], self.check[fresh] = True, other[first]
        self.names += [(i, langs[phrases.text[p]], phrases.phrase(p, k), k) for i, p in zip(fresh.tolist(), places[first].tolist(), strict=True)]
        # Phrases that share the hash of another are told by a second one.
        odd = self.check[at] != other
        if odd.any():
            for p in places[odd].tolist():
                self._by_text(langs[phrases.text[p]], phrases.phrase(p, k), k, 1)
            at = at[~odd]
        self.held.append(at)
        if sum(map(len, self.held)) >= HELD:
            self._settle()

    def _by_text(self, lang: str, phrase: str, k: int, n: int) -> None:
        self.texts[lang, phrase, k] = self.texts.get((lang, phrase, k), 0) + n

    def _settle(self) -> None:
        if self.held:
            self.count += np.bincount(np.concatenate(self.held), minlength=len(self.count))
            self.held.clear()

    def full(self) -> bool:
        return self.met >= MOST_MET or len(self.names) + len(self.texts) >= MOST_NAMES

    def rows(self) -> Iterator[tuple[str, str, int, int]]:
        """(lang, phrase, k, n) of all that was met; nothing is left."""
        self._settle()
        for i, lang, phrase, k in self.names:
            yield lang, phrase, k, int(self.count[i])
        for (lang, phrase, k), n in self.texts.items():
            yield lang, phrase, k, n
        self.names.clear()
        self.texts.clear()
        self.count[:] = 0
        self.seen[:] = False
        self.met = 0


def phrase_rows(docs: DataFrame, longest: int, only: np.ndarray | None = None, shift: int = 0) -> DataFrame:
    """(lang, phrase, k, n): phrases of k words with parts of their counts, those whose hash without its last ``shift`` bits is in ``only`` (sorted); k = 0 counts all words."""
    sent = docs.sparkSession.sparkContext.broadcast(only)
    names = ["lang", "phrase", "k", "n"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(sent.value, shift)

        def out() -> Iterator[pa.RecordBatch]:
            found = counts.rows()
            while part := list(islice(found, AT_ONCE)):
                lang, phrase, k, n = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names)

        for phrases, langs in _each_slice(batches):
            counts.add(phrases, langs, longest)
            if counts.full():
                yield from out()
        yield from out()

    return _read(docs).mapInArrow(rows, "lang string, phrase string, k int, n long")


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts in small letters with full stops between pieces), about ``TEXT_BYTES`` of all languages at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def out() -> Iterator[tuple[str, bytes]]:
        for lang, texts in held.items():
            yield lang, b".".join(texts).translate(_PLAIN)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            held.setdefault(lang, []).append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            size += len(held[lang][-1])
            if size >= TEXT_BYTES:
                yield from out()
                size = 0
    yield from out()


def _words(text: bytes) -> pa.DictionaryArray:
    """What stands between spaces and tabs; the first and the last one may be empty."""
    whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text))
    return pc.ascii_split_whitespace(whole).flatten().dictionary_encode()


def word_counts(docs: DataFrame, fewest: int) -> DataFrame:
    """(lang, word, n) of the words that occur ``fewest`` times or more, and of all words of a language (word is empty)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _by_language(batches):
            found = _words(text.replace(b".", b" "))
            n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
            words = found.dictionary.cast(pa.string())
            empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
            n[empty] = 0
            words, n = pa.concat_arrays([words, pa.array([""])]), np.append(n, n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), words, pa.array(n, pa.int64())], ["lang", "word", "n"])

    found = _read(docs).mapInArrow(rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= fewest) | (F.col("word") == ""))


class Vocabulary:
    """The words of each language, numbered from 1 on over all languages."""

    def __init__(self, words: pa.Table) -> None:
        words = words.sort_by("lang")
        self.langs, self.words = (words[c].combine_chunks().cast(pa.large_string()) for c in ("lang", "word"))
        found = self.langs.value_counts()
        n = found.field("counts").to_numpy()
        self.range = {lang: (int(end - k), int(end)) for lang, k, end in zip(found.field("values").to_pylist(), n, np.cumsum(n), strict=True)}

    def numbers(self, lang: str, words: pa.Array) -> np.ndarray:
        """The number of each word, 0 where it has none."""
        a, b = self.range.get(lang, (0, 0))
        found = pc.index_in(words, self.words.slice(a, b - a))
        return pc.fill_null(pc.add(found.cast(pa.int64()), a + 1), 0).to_numpy(zero_copy_only=False).astype(np.uint64)


def numbered_counts(docs: DataFrame, words: pa.Table, met: int, fewest: int, longest: int) -> DataFrame:
    """(lang, phrase, k, n) of the phrases of 2 to ``longest`` words, all of them in ``words`` (lang, word), that occur ``fewest`` times or more. ``met`` tells how many words there are in all."""
    width = words.num_rows.bit_length()
    bits = width * longest
    ranges, mask = min(_ranges(met * (longest - 1)), bits), np.uint64((1 << bits) - 1)
    # A bijection that spreads the keys over all ranges, and its inverse.
    step, half = 0x9E3779B97F4A7C15, np.uint64((bits + 1) // 2)
    forth, back = np.uint64(step), np.uint64(pow(step, -1, 1 << 64))
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(words))
    at_word = [np.uint64(width * (longest - 1 - j)) for j in range(longest)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for lang, text in _by_language(batches):
            words = _words(text.replace(b".", b" . "))
            # What is rare, as what lies between pieces, has no number: no frequent phrase goes past it.
            numbers = np.append(sent.value.numbers(lang, words.dictionary)[words.indices.to_numpy()], np.zeros(longest, np.uint64))
            places, found = np.flatnonzero(numbers), []
            key = numbers[places] << at_word[0]
            for j in range(1, longest):
                more = numbers[places + j]
                keep = more != 0
                places, key = places[keep], key[keep] | more[keep] << at_word[j]
                mixed = key * forth & mask
                found.append((mixed ^ mixed >> half) * forth & mask)
            yield found

    def give(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        known = sent.value
        mixed = found * back & mask
        key = (mixed ^ mixed >> half) * back & mask
        numbers = [(key >> x & np.uint64((1 << width) - 1)).astype(np.int64) - 1 for x in at_word]
        parts = [known.words.take(pa.array(x, mask=x < 0)) for x in numbers]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()), null_handling="skip")
        k = sum((x >= 0).astype(np.int32) for x in numbers)
        return pa.RecordBatch.from_arrays([known.langs.take(pa.array(numbers[0])).cast(pa.string()), phrase.cast(pa.string()), pa.array(k), pa.array(n)], ["lang", "phrase", "k", "n"])

    return _counted(docs, keys, bits, ranges, fewest, give, "lang string, phrase string, k int, n long")


def hashed_counts(docs: DataFrame, stage: Staging, fewest: int, longest: int) -> DataFrame:
    """(lang, phrase, k, n) of the phrases of 2 to ``longest`` words that occur ``fewest`` times or more, whatever their words."""
    hashes, shift = frequent_hashes(docs, fewest, longest)
    frequent = stage.put(hashes, "hashes")
    only = np.sort(frequent.toArrow().column(0).to_numpy().view(np.uint64)) if frequent.count() <= BROADCAST_IDS else None
    counts = phrase_rows(docs, longest, only, shift).where("k > 1").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= fewest)


def phrase_counts(docs: DataFrame, fewest: int = FEWEST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, k, n) of the phrases of k words that occur ``fewest`` times or more, and of all words (k = 0), as a written table."""
    stage = Staging(docs.sparkSession, "phrases")
    words = stage.put(word_counts(docs, fewest), "words")
    found = words.select("lang", F.col("word").alias("phrase"), F.when(F.col("word") == "", 0).otherwise(1).alias("k"), "n")
    own = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    for langs in _together(words.where("word <> ''").groupBy("lang").count().orderBy("lang").collect()):
        part, known = docs.where(own.isin(langs)), words.where((F.col("word") != "") & F.col("lang").isin(langs)).select("lang", "word")
        size, met = known.count(), words.where((F.col("word") == "") & F.col("lang").isin(langs)).agg(F.sum("n")).first()[0]
        if size <= BROADCAST_IDS and size.bit_length() * longest <= KEY_BITS:
            counts = numbered_counts(part, known.toArrow(), met, fewest, longest)
        else:
            counts = hashed_counts(part, stage, fewest, longest)
        found = found.union(stage.put(counts, "counts").select(*found.columns))
    return found


def _together(sizes: Iterable[tuple[str, int]]) -> list[list[str]]:
    """Languages in groups whose words can be sent together, as long as those of one can."""
    groups, left = [], 0
    for lang, n in sizes:
        if n > left:
            groups.append([])
            left = BROADCAST_IDS
        groups[-1].append(lang)
        left -= n
    return groups


def _part(start: int, size: Column | int) -> Column:
    """``size`` words of the phrase from the place ``start`` on."""
    return F.array_join(F.slice(F.split("phrase", " "), start, size), " ")


def collocations(docs: DataFrame, fewest: int = FEWEST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best ``most`` candidates of each language of ``docs`` (text, lang)."""
    if longest < 2:
        raise ValueError("phrases have at least two words")
    counted = phrase_counts(docs, fewest, longest)
    counts, totals = counted.where("k > 0"), counted.where("k = 0").select("lang", "n")
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    # Each part of a candidate occurs at least as often, so all parts are among the counts.
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumns({"first": _part(1, F.col("cut")), "rest": F.expr("array_join(slice(split(phrase, ' '), cut + 1, k), ' ')")})
    cuts = cuts.join(part.withColumnsRenamed({"part": "first", "count": "l"}), ["lang", "first"]).join(part.withColumnsRenamed({"part": "rest", "count": "r"}), ["lang", "rest"])
    a, left, right = (F.col(x).cast(_COUNT) for x in ("a", "l", "r"))
    cuts = cuts.withColumns({"over": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "under": left * right}).withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = candidates.where("k > 2")
    covers = longer.select("lang", _part(1, F.col("k") - 1).alias("phrase"), F.col("a").alias("by")).union(longer.select("lang", F.expr("array_join(slice(split(phrase, ' '), 2, k), ' ')"), "a"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    held = scored.join(covers, ["lang", "phrase"], "left").where(F.col("by").isNull() | (100 * F.col("by") < COVERED * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = held.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    # One row a language.
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
