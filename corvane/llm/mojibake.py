"""Texts read in a wrong character encoding, restored by minimum description length.

A chain says which encoding the bytes were in and in which they were read. Every chain gives a candidate text; of a chain that only swaps single
characters the best run of words is taken, so that a text garbled in part is restored in part, and of a multi-byte chain those sequences that are
whole characters. The description length of a text is its size under zstandard with a dictionary of its language, plus the cost of
the chain. The shortest description wins, chains are peeled off one after another for as long as one pays, and where none does the text is left unchanged.

Every chain is judged twice. First word by word: a chain changes some words, the dictionary says how much shorter each gets (a task remembers
words, so this costs a look-up): the sum over all words, and over the run of words that gains most, with what unusual letters add, says what the chain gains in
the whole text and in a run of it. A word alone is described a little less well than among others, so a chain is out only where it falls ``MARGIN`` bytes short of its cost, or
can't reach what another chain has gained. The others are described with the whole text.

The dictionaries are fitted on every text that nothing speaks against: letters, words and successive words are counted over all of them, and a language's
dictionary is made of those that count for most. Every text is judged.

Defined cases
* Null, empty and pure ASCII texts are never garbled, but for doubled question marks inside words.
* A text that holds the replacement character, or a question mark for every byte of a character inside a word, lost characters for good: it is reported with no restored text.
* A language that is null or has no dictionary is tried with all of them.
* Texts are judged whole, however long; repeated texts come out once per key.
* Rows repeated count as often for the dictionaries as they are there.
* An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import process_cache, spread

#: Bytes of a dictionary, and languages that get one, the most frequent ones (two-letter codes are fewer).
DICTIONARY, LANGUAGES = 112_640, 256
#: Counts that a task holds before it hands them on to be summed up.
HELD = 200_000
#: Words that a dictionary's code lengths are fitted on, about: as often as their counts say, and each once at least.
WEIGHED = 200_000
#: A phrase of the dictionary goes on with pieces that count for this share of its first one at least.
FOLLOWS = 0.1
#: Bytes that a single-byte chain costs, a run of words in place of the whole text, a multi-byte chain, and each block of
#: characters, new to the language, that it brings in, and each unusual character that a single-byte chain does.
CHAIN_COST, RUN_COST, BYTES_COST, BLOCK_COST, LETTER_COST = 2.5, 2.0, 1.0, 10.0, 2.0
#: Bytes by which a chain's gain, summed up word by word, may fall short of its cost and still pay in the whole text.
MARGIN = 2.5
#: Bytes that an unusual character in place of a usual one may cost beyond its own word, as it breaks what a word and its neighbours share with the dictionary.
CONTEXT = 2.0
#: Bytes that an unusual character, and a control character, count for where a chain takes it away and brings none in.
LETTER_GAIN, CONTROL_GAIN = 1.0, 6.0
#: A training text has no character that fewer of its language's texts have.
USUAL = 0.02
#: Words of a language whose descriptions a worker remembers.
WORDS_KEPT = 60_000
#: Encodings a text's bytes may have been read in.
READ_AS = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251", "cp1250", "iso8859-15")
#: Single-byte chains: the bytes' encoding and the one they were read in.
SWAPS = tuple(
    (was, read)
    for was in ("cp1252", "cp850", "mac_roman", "cp437")
    for read in ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251", "cp1250")
    if was != read and {was, read} != {"cp850", "cp437"}
)
#: What stands for lost characters: the replacement character, or a question mark for each byte of a character inside a word.
LOST = r"�|(?<=[^\W\d_’'])\?{2,4}(?=[^\W\d_])"


def byte_of(encoding: str) -> dict[str, int]:
    """The byte of every character beyond ASCII. Bytes the encoding leaves undefined were read as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if encoding == "cp1252":  # readers mix this encoding with its plain subset
        out |= {chr(b): b for b in range(128, 160)}
    return out


def char_of(encoding: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            pass
    return out


class MultiByte:
    """UTF-8 bytes read in a single-byte encoding, once or several times: every run that is whole characters is put right."""

    def __init__(self, read: str, blank: bool = False):
        self.name = f"utf-8 as {read}" + " with blanks" * blank
        self.bytes = byte_of(read)
        group = lambda a, b: "[" + "".join(re.escape(c) for c, x in sorted(self.bytes.items()) if a <= x <= b) + "]"
        tail = group(0x80, 0xBF)
        whole = f"{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}}"
        if blank:  # a no-break space inside a character was later made a blank
            whole += f"|{group(0xC3, 0xC3)} "
            self.bytes[" "] = 0xA0
        self.pattern = re.compile(whole)

    def _one(self, m: re.Match) -> str:
        try:
            return bytes(self.bytes[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    def candidates(self, text: str, judge: Judge) -> Iterator[tuple[str, float]]:
        cost = 0.0
        while self.pattern.search(text):
            before, text = text, self.pattern.sub(self._one, text)
            if text == before:  # sequences that are no characters
                return
            cost += BYTES_COST + judge.strange(before, text)
            yield text, cost


class Swap:
    """Bytes of one single-byte encoding read in another: the whole text, or the run of words where it pays most."""

    def __init__(self, was: str, read: str):
        self.name = f"{was} as {read}"
        right = char_of(was)
        self.table = {ord(c): right[b] for c, b in byte_of(read).items() if b in right and right[b] != c}

    def candidates(self, text: str, judge: Judge, changed: list | None = None, whole: bool = True) -> Iterator[tuple[str, float]]:
        """The whole text put right, and the run of words that gains most. ``changed``: matches and gains of the words it changes; an empty list for no run."""
        if whole:
            put = text.translate(self.table)
            yield put, CHAIN_COST + judge.swapped(text, put)
        if changed is None:
            changed = [(m, judge.gain(m[0], put)) for m in judge.words.finditer(text) if (put := m[0].translate(self.table)) != m[0]]
        if (run := self._run(changed)) and (run[0] > 0 or run[1] + 1 < len(changed)):
            a, b = changed[run[0]][0].start(), changed[run[1]][0].end()
            put = text[a:b].translate(self.table)
            yield text[:a] + put + text[b:], CHAIN_COST + RUN_COST + judge.swapped(text[a:b], put)

    def _run(self, changed: list) -> list[int] | None:
        """The changed words, from one to another, whose descriptions gain most."""
        best = gain = start = 0
        run = None
        for k, (_, g) in enumerate(changed):
            if gain <= 0:
                gain, start = 0, k
            gain += g
            if gain > best:
                best, run = gain, [start, k]
        if not run:
            return None
        # words beside it belong to it where they gain, or have the run's own wrong characters and lose nothing
        wrong = {c for m, _ in changed[run[0] : run[1] + 1] for c in m[0] if ord(c) in self.table}
        alike = lambda k: changed[k][1] > 0 or changed[k][1] == 0 and all(c in wrong for c in changed[k][0][0] if ord(c) in self.table)
        while run[0] > 0 and alike(run[0] - 1):
            run[0] -= 1
        while run[1] + 1 < len(changed) and alike(run[1] + 1):
            run[1] += 1
        return run


class Judge:
    """Description lengths under one language's dictionary."""

    #: A word with a character beyond ASCII; what stands before that character is never tried twice.
    words = re.compile(r"(?<![!-~])[!-~]*+[^\x00-\x7f]\S*")

    def __init__(self, dictionary: bytes, usual: str):
        data = zstandard.ZstdCompressionDict(dictionary)
        self.squeeze = zstandard.ZstdCompressor(level=5, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.usual = frozenset(usual)
        self.blocks = {ord(c) >> 8 for c in usual} | {0}
        self.gain = lru_cache(WORDS_KEPT)(self._gain)
        #: What each swap gains in a word, letters aside and with them; no number for a word it doesn't change.
        self.known: dict[str, np.ndarray] = {}

    def strange(self, text: str, put: str) -> float:
        """The cost of blocks of characters that a chain brings in and the language hasn't."""
        if put.isascii():
            return 0.0
        return BLOCK_COST * len({ord(c) >> 8 for c in set(put) - set(text)} - self.blocks)

    def letters(self, text: str) -> float:
        """The cost of the characters of a text that are unusual in the language; control characters are most unusual."""
        return sum(CONTROL_GAIN if "\x80" <= c <= "\x9f" else LETTER_GAIN for c in set(text) - self.usual)

    def swapped(self, text: str, put: str) -> float:
        """The cost of a swap beside the chain's: unusual characters it brings in, or else a gain for those it takes away, and
        bytes saved only because a usual character takes more of them than the one put for it."""
        brought = set(put) - set(text) - self.usual
        cost = LETTER_COST * len(brought) if brought else self.letters(put) - self.letters(text)
        for c, n in Counter(text).items():
            if c in self.usual and ord(c) > 127:
                cost += n * max(0, len(c.encode()) - len(put[text.index(c)].encode()))
        return cost

    def size(self, text: str) -> int:
        return len(self.squeeze.compress(text.encode("utf-8", "surrogatepass")))

    def _gain(self, word: str, put: str) -> float:
        """By how much a word's description gets shorter; a usual word that would become unusual never does."""
        usual = self.usual
        if not usual.issuperset(put) and usual.issuperset(word):
            return -LETTER_COST
        return self.size(f" {word} ") - self.size(f" {put} ") - self.swapped(word, put)

    def promising(self, text: str, swaps: Sequence[Swap]) -> Iterator[tuple[float, Callable[[], Iterator[tuple[str, float]]]]]:
        """The swaps that may pay, as what they gain at most and their candidates, the greatest first."""
        known, rows, matches = self.known, [], list(self.words.finditer(text))
        for m in matches:
            got = known.get(m[0])
            if got is None:
                got = self._swapped_word(m[0], swaps)
                if len(known) > WORDS_KEPT:
                    known.clear()
                known[m[0]] = got
            rows.append(got)
        if not rows:
            return
        table = np.array(rows)
        total = np.zeros((len(rows) + 1, len(swaps)))
        np.cumsum(table[:, 0], axis=0, out=total[1:])
        letters = np.zeros(len(swaps))
        for c in set(text) - self.usual:
            if ord(c) > 127:
                letters += np.array([ord(c) in s.table for s in swaps]) * (CONTROL_GAIN if "\x80" <= c <= "\x9f" else LETTER_GAIN)
        whole = total[-1] + letters - CHAIN_COST + MARGIN
        run = (total - np.minimum.accumulate(total, axis=0)).max(0) + letters - CHAIN_COST - RUN_COST + MARGIN
        bounds = np.maximum(whole, run)
        for i in np.argsort(-bounds, kind="stable").tolist():
            if bounds[i] <= 0:
                return
            gains = table[:, 1, i]
            changed = [(matches[k], float(gains[k])) for k in np.flatnonzero(~np.isnan(gains))] if run[i] > 0 else []
            yield float(bounds[i]), partial(swaps[i].candidates, text, self, changed, bool(whole[i] > 0))

    def _swapped_word(self, word: str, swaps: Sequence[Swap]) -> np.ndarray:
        """By how much each swap shortens a word's description, letters aside and with them."""
        out = np.zeros((2, len(swaps)), np.float32)
        size = usual = odd = None
        for i, s in enumerate(swaps):
            put = word.translate(s.table)
            if put == word:
                out[1, i] = np.nan
                continue
            if size is None:
                size, usual = self.size(f" {word} "), self.usual.issuperset(word)
                odd = [ord(c) for c in word if c not in self.usual]
            if usual and not self.usual.issuperset(put):
                out[:, i] = -LETTER_COST
            else:
                out[0, i] = size - self.size(f" {put} ")
                out[1, i] = out[0, i] - self.swapped(word, put)
                out[0, i] += CONTEXT * sum(s.table.get(c) in self.usual for c in odd)
        return out


class Restorer:
    """The chains, and a judge of each language."""

    def __init__(self, dictionaries: dict[str, tuple[bytes, str]]):
        self.judges = {lang: Judge(*d) for lang, d in dictionaries.items()}
        self.bytes = [*(MultiByte(r) for r in READ_AS), MultiByte("cp1252", True)]
        self.swaps = [Swap(w, r) for w, r in SWAPS]
        #: Without two such characters side by side no bytes were misread.
        self.pair = re.compile("[^\x00-\x7f][^\x00-\x7f]")
        self.lost = re.compile(LOST)

    def best(self, text: str, judge: Judge) -> tuple[str, float]:
        """The text with the shortest description, and how many bytes that saves."""
        saved = 0.0
        peeled: set[str] = set()
        while text not in peeled:
            peeled.add(text)
            now = least = None
            choice = None
            seen = {text}
            chains = [(np.inf, partial(c.candidates, text, judge)) for c in self.bytes] if "Ã " in text or self.pair.search(text) else []
            for bound, candidates in chain(chains, judge.promising(text, self.swaps)):
                if choice is not None and bound <= now - least:
                    break
                for other, cost in candidates():
                    if other in seen:
                        continue
                    seen.add(other)
                    if now is None:
                        now = least = judge.size(text)
                    size = judge.size(other) + cost
                    if size < least:
                        choice, least = other, size
            if choice is None:
                break
            saved += now - least
            text = choice
        return text, saved

    def restore(self, text: str | None, lang: str | None) -> str | None:
        """The restored text; an empty one where characters are lost for good; None for a text that isn't garbled."""
        if not text:
            return None
        if ("\ufffd" in text or "??" in text) and self.lost.search(text):
            return ""
        if text.isascii():
            return None
        if not self.judges:
            return None
        judges = [self.judges[lang]] if lang in self.judges else list(self.judges.values())
        # of an unknown language, the one that describes the text as it stands best
        judge = min(judges, key=lambda j: j.size(text))
        better, saved = self.best(text, judge)
        return better if saved > 0 else None


#: What speaks against a text: led by the characters themselves, so that most places are passed by in one step.
_SUSPECT = re.compile(
    "[À-ÖØ-ÞŸŒ‡∞√├┬\x80-\x9f\ufffdГв]"
    "(?:(?<=[a-zß-ÿ][À-ÖØ-ÞŸŒ‡∞√├┬])|(?<=[ÃÂ])[\x80-\xbf]|(?<=[\x80-\x9f\ufffd])|(?<=[├┬√Гв])[\x80-\uffff])"
)


def usual(texts: list[str]) -> tuple[list[str], str]:
    """The characters that are usual in a language's sample, and the texts without others; all texts, where that leaves few."""
    texts_with: dict[str, int] = {}
    for t in texts:
        for c in set(t):
            texts_with[c] = texts_with.get(c, 0) + 1
    rare = {c for c, n in texts_with.items() if n < USUAL * len(texts) and ord(c) > 127}
    kept = [t for t in texts if rare.isdisjoint(t)]
    return (kept if len(kept) * 4 >= len(texts) else texts), "".join(sorted(set(texts_with) - rare))


#: Characters of the scripts that set no blanks, words of their own.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: A word with the blank before it; longer runs in parts.
_UNBROKEN = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(rf"[{_UNSPACED}]| ?[^\s{_UNSPACED}]{{1,32}}")
#: Bytes of each of the three last distances, that a dictionary's code lengths end with.
_DISTANCES = b"\1\0\0\0\4\0\0\0\x08\0\0\0"


def pieces(text: str) -> list[str]:
    """A text's words, and its runs of three words with a character beyond ASCII, which alone a chain puts in."""
    words = [" " + w for w in text.split()]
    if max(map(len, words), default=0) > 33 or _UNBROKEN.search(text):
        words = _WORD.findall("".join(words))
    return words + [t for a, b, c in zip(words, words[1:], words[2:]) if not (t := a + b + c).isascii()]


def phrases(worth: dict[str, int]) -> bytes:
    """A dictionary's content: the pieces that are worth most, as phrases in which runs of words overlap; the best last, where they are cheapest to name."""
    words_of = {p: _WORD.findall(p) for p in worth}
    after, before = defaultdict(list), defaultdict(list)
    for p, w in words_of.items():
        if len(w) == 3:
            after[w[0], w[1]].append(p)
            before[w[1], w[2]].append(p)
    used: set[str] = set()
    out, size = [], 0
    for p, w in words_of.items():
        if size >= DICTIONARY:
            break
        if p in used:
            continue
        used.add(p)
        phrase, least = list(w), worth[p] * FOLLOWS
        if len(w) == 3:
            for known, ends, new, at in ((after, slice(-2, None), -1, lambda: len(phrase)), (before, slice(0, 2), 0, lambda: 0)):
                while (then := next((x for x in known[tuple(phrase[ends])] if x not in used), None)) and worth[then] >= least:
                    used.add(then)
                    phrase.insert(at(), words_of[then][new])
        used.update(phrase)
        out.append("".join(phrase))
        size += len(out[-1].encode("utf-8", "surrogatepass"))
    return ("".join(reversed(out)) + " ").encode("utf-8", "surrogatepass")[-DICTIONARY:]


def trained(counts: list[tuple[str, int]]) -> bytes:
    """A zstandard dictionary of a language's pieces, those that are worth most first, and how often all its texts have them."""
    content = phrases({p: n * len(p.encode("utf-8", "surrogatepass")) for p, n in counts})
    # code lengths are fitted on texts that have the words in proportion to their counts
    words = [(p, n) for p, n in counts if " " not in p[1:]]
    total, done, drawn = sum(n for _, n in words), 0, []
    weighed = min(WEIGHED, total)
    for p, n in words:
        drawn += [p] * max(1, (done + n) * weighed // total - done * weighed // total)
        done += n
    random.Random(1).shuffle(drawn)
    try:
        codes = zstandard.train_dictionary(DICTIONARY, ["".join(drawn[i : i + 130]).encode("utf-8", "surrogatepass") for i in range(0, len(drawn), 130)]).as_bytes()
    except zstandard.ZstdError:  # too few words to fit them on
        return content
    codes = codes[: codes.index(_DISTANCES) + len(_DISTANCES)]
    return codes + content[-(DICTIONARY - len(codes)) :]


def tallied(texts: DataFrame, parts: Callable[[str, str], tuple[bool, Iterable[str]]]) -> DataFrame:
    """``lang, kept, piece, n``: what ``parts`` gives for each language and text that nothing speaks against, counted by task; the empty piece counts the texts."""
    names = ["lang", "kept", "piece", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], Counter] = defaultdict(Counter)
        held = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, kept), c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([kept] * len(c), pa.bool_()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names)
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if _SUSPECT.search(text):
                    continue
                kept, found = parts(lang, text)
                c = counts[lang, kept]
                held -= len(c)
                c.update(found)
                c[""] += 1
                held += len(c)
                if held > HELD:
                    yield from handed()
                    held = 0
        yield from handed()

    return texts.mapInArrow(run, "lang string, kept boolean, piece string, n bigint")


def dictionaries(df: DataFrame, *, text: str = "text", lang: str = "lang") -> dict[str, tuple[bytes, str]]:
    """A zstandard dictionary and the usual characters of each language, from all texts that nothing speaks against.

    Tasks count, the counts are summed up, and executors make the dictionaries, a language a task, of the pieces that are worth most; the driver
    gets ``LANGUAGES`` dictionaries of ``DICTIONARY`` bytes and their code lengths at most.
    """
    texts = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    texts = spread(texts.where(F.col("lang").isNotNull() & (F.col("text") != "")))
    texts_with = tallied(texts, lambda _, t: (True, set(t))).groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    by_lang = texts_with.groupBy("lang").agg(F.sum(F.when(F.col("piece") == "", F.col("n"))).alias("texts"), F.collect_list(F.struct("piece", "n")).alias("letters"))
    usually = F.filter("letters", lambda x: (x["piece"] != "") & ((x["piece"] <= "\x7f") | (x["n"] >= F.col("texts") * F.lit(USUAL))))
    by_lang = by_lang.orderBy(F.desc("texts"), "lang").limit(LANGUAGES).select("lang", F.array_join(F.array_sort(F.transform(usually, lambda x: x["piece"])), "").alias("letters"))
    letters = {r["lang"]: r["letters"] for r in by_lang.collect()}
    if not letters:
        return {}
    rare = {name: re.compile("[^\x00-\x7f" + re.escape(known) + "]") for name, known in letters.items()}
    counts = tallied(texts.where(F.col("lang").isin(*letters)), lambda name, t: (not rare[name].search(t), pieces(t)))
    counts = counts.groupBy("lang", "piece").agg(F.sum(F.when(F.col("kept"), F.col("n"))).alias("kept"), F.sum("n").alias("all"))
    # texts without rare characters, and all of them
    counts = counts.select("lang", "piece", F.explode(F.array(F.struct(F.lit(True).alias("kept"), F.col("kept").alias("n")), F.struct(F.lit(False).alias("kept"), F.col("all").alias("n")))).alias("v"))
    counts = counts.select("lang", "piece", "v.kept", "v.n").where((F.col("n") > 0) & ((F.col("piece") == "") | (F.octet_length("piece") > 2)))
    worth = F.when(F.col("piece") == "", F.lit((1 << 63) - 1)).otherwise(F.col("n") * F.octet_length("piece"))
    # no more pieces of a kind than the dictionary has bytes
    kinds = Window.partitionBy("lang", "kept", F.col("piece").rlike(". ")).orderBy("least", "piece")
    best = counts.withColumn("least", -worth).withColumn("place", F.row_number().over(kinds)).where(F.col("place") <= DICTIONARY)

    def fit(table: pa.Table) -> pa.Table:
        of: dict[bool, list] = {True: [], False: []}
        for least, piece, kept, n in sorted(zip(*(table.column(c).to_pylist() for c in ("least", "piece", "kept", "n")))):
            of[kept].append((piece, n))
        # the empty piece comes first: the number of texts
        counts = of[bool(of[True]) and of[True][0][1] * 4 >= of[False][0][1]][1:]
        return pa.table({"lang": table.column("lang")[:1], "dictionary": pa.array([trained(counts)], pa.binary())})

    fitted = best.groupBy("lang").applyInArrow(fit, "lang string, dictionary binary")
    return {r["lang"]: (bytes(r["dictionary"]), letters[r["lang"]]) for r in fitted.collect()}


def restored(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, restored_md5`` of the garbled texts: the MD5 of the restored text, empty where characters are lost."""
    known = dictionaries(df, text=text, lang=lang)
    src = df.select(F.col(key), F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("__lang"))
    # a text of ASCII without lost characters isn't garbled: it never reaches Python
    src = spread(src.where(F.col("__text").rlike(r"[^\x{00}-\x{7F}]|\?\?")))
    schema = T.StructType([src.schema[key], T.StructField("restored_md5", T.StringType(), False)])

    mark = hashlib.sha256(repr(sorted(known.items())).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tasks of one worker share what they learned of words
        kept = process_cache()
        if kept.get("restorer", ("",))[0] != mark:
            kept["restorer"] = mark, Restorer(known)
        machine = kept["restorer"][1]
        for batch in batches:
            rows, sums = [], []
            for i, (t, name) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                got = machine.restore(t, name)
                if got is not None:
                    rows.append(i)
                    sums.append(hashlib.md5(got.encode("utf-8", "surrogatepass")).hexdigest() if got else "")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sums, pa.string())], schema.names)

    return src.mapInArrow(run, schema)
