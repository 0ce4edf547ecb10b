"""Messages with template residue, filler, error pages or script notices instead of content.

The labelled exemplars stand in an inverted index by word. Of each message the subject and
the newly written text are taken and cut into windows: sentences, lines, and for long ones runs of
words. A window is looked up by its words; it is contained in an exemplar to the share of its
TF-IDF weight that the exemplar's words hold. A message whose new text is mostly contained in
residue exemplars is left out.

A placeholder is a window of its own: its delimiters, and the words of the name between them. It is
looked up among the exemplars of placeholders, where a slot holds any name, and counts where it is contained in one, unless
the sentence around it, with ``slot`` in its place, is contained in an exemplar of talk about placeholders.

Words of a whole batch are numbered once; weights, shares and the halves of windows are sums over arrays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import exemplars, mail
from .encoding import hash_bytes, spread

#: Document frequencies are counted in this many buckets of hashed words, so their table is bounded.
BUCKETS = 1 << 16
#: A window is residue if an exemplar holds this share of its weight,
CONTAINED = 0.75
#: where at least this share isn't held by the words that give the number of an error,
CORE = 0.35
#: a placeholder if one holds this share of its name,
SLOT = 0.5
#: and a sentence is talk from this share on,
TALK = 0.5
#: if it holds this share of the exemplar in turn.
TALK_BACK = 0.4
#: A message is residue if such windows make up this share of its words.
COVERED = 0.6
#: Words of one window at most; longer sentences are cut. A window that isn't contained is halved, down to LEAST_WORDS.
WINDOW_WORDS, LEAST_WORDS = 40, 3
#: Messages of one task, characters worked on at once, and words that a worker remembers between two such blocks.
MESSAGES_PER_TASK, BLOCK_CHARS, WORDS_KEPT = 4_000, 4_000_000, 400_000

_WORDS = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")
_TRACE = re.compile(r"\b[0-9a-f]{4,}(?:-[0-9a-f]{3,})+\b", re.I)
_URL = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n")
_NAME = r"[^\W\d_][\w.\-]*(?: [\w.\-]+){0,3}"
#: Where a placeholder may begin.
_BEGIN = re.compile(r"[{<$#*@%(\[_\\«]|XXXXX")
# The delimiters of placeholders, by the name that exemplars give them.
_SHAPES = {
    "{{{": rf"\{{\{{\{{ ?{_NAME} ?\}}\}}\}}", "{{": rf"\{{\{{ ?{_NAME} ?\}}\}}", "{%": rf"\{{% ?{_NAME} ?%\}}", "<%": rf"<%=? ?{_NAME} ?%>", "${": rf"\$\{{ ?{_NAME} ?\}}",
    "#{": rf"#\{{ ?{_NAME} ?\}}", "{!": rf"\{{!{_NAME}\}}", "*|": rf"\*\|{_NAME}\|\*", "@@": rf"@@{_NAME}@@", "##": rf"##{_NAME}##", "%%": rf"%%{_NAME}%%", "%(s": rf"%\({_NAME}\)s",
    "[[": rf"\[\[ ?{_NAME} ?\]\]", "<<": rf"<<{_NAME}>>", "(goes-here": rf"\({_NAME} goes here\)", "[insert": rf"\[INSERT {_NAME} HERE\]",
    "__": r"(?<!_)__[^\W\d_](?:[\w.\-]*[^\W_])?__(?!_)", "xxxxx": r"(?<!\w)(?-i:XXXXX)(?!\w)", "____": r"(?<!_)_{8,19}(?!_)", "{0": r"(?<![\w{$#%]){\d}(?!\w)",
    "{": rf"(?<![\w{{$#%])\{{{_NAME}\}}", "<": rf"(?<![<\w])<{_NAME}>", "[": rf"(?<![\w\[])\\?\[{_NAME}\\?\]", "%": rf"(?<![\w%])%{_NAME}%", "$": rf"(?<![\w$])\${_NAME}\$", "«": rf"«{_NAME}»",
}
_PLACEHOLDER = re.compile("|".join(f"(?P<k{i}>{x})" for i, x in enumerate(_SHAPES.values())), re.I)
_NAMES = list(_SHAPES)
_PARTS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z])")


def normal(word: str) -> str:
    """A word as it is compared; ASCII words with a digit are "0", other digits are 0."""
    if word.isalpha():
        return word
    word = word.strip("_")
    if not word or word.isalpha():
        return word
    return "0" if word.isascii() and _DIGITS.search(word) else _DIGITS.sub("0", word)


def words_of(text: str) -> list[str]:
    """Words in lower case."""
    return [x for x in map(normal, _WORDS.findall(_TRACE.sub("0", text).casefold())) if x]


def bucket(word: str) -> int:
    return hash_bytes(word.encode("utf-8", "surrogatepass")) % BUCKETS


def slots(text: str) -> list[tuple[int, int, str, list[str]]]:
    """What has the form of a placeholder: (begin, end, delimiters, words of the name)."""
    out, at = [], 0
    while m := _BEGIN.search(text, at):
        found = _PLACEHOLDER.match(text, m.start())
        if not found:
            at = m.start() + 1
            continue
        at = found.end()
        shape = _NAMES[int(found.lastgroup[1:])]
        out.append((m.start(), at, shape, [x.casefold() for x in _PARTS.findall(_CAMEL.sub(" ", found[0]))]))
    return out


class _Numbers(dict):
    """Numbers of words as written, with what is known of each."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.buckets: list[int] = []

    def __missing__(self, raw: str) -> int:
        word = normal(raw)
        self[raw] = n = len(self.words)
        self.words.append(word)
        self.buckets.append(bucket(word))
        return n


def blocks(texts: list[str]) -> Iterator[slice]:
    """Slices of whole texts with about BLOCK_CHARS characters."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > BLOCK_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if len(texts) > start:
        yield slice(start, len(texts))


def numbered(texts: list[str], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words in order, the number of words of each window, and the text of each window."""
    raws: list[str] = []
    lengths: list[int] = []
    of: list[int] = []
    for k, text in enumerate(texts):
        if not text:
            continue
        if "@" in text or "://" in text or "www." in text:
            text = _URL.sub(" ", text)
        if "-" in text:
            text = _TRACE.sub("0", text)
        for sentence in _SENTENCE.split(text.casefold()):
            found = _WORDS.findall(sentence)
            n = len(found)
            if n:
                raws += found
                while n > WINDOW_WORDS:
                    lengths.append(WINDOW_WORDS)
                    of.append(k)
                    n -= WINDOW_WORDS
                lengths.append(n)
                of.append(k)
    ids = np.fromiter(map(numbers.__getitem__, raws), np.int64, len(raws))
    return ids, np.array(lengths, np.int64), np.array(of, np.int64)


class Index:
    """Inverted index of the exemplars, with the weights of words."""

    def __init__(self, frequency: np.ndarray, documents: int) -> None:
        self.by_bucket = 0.1 + np.log((documents + 1) / (frequency + 1.0))
        self.numbers = _Numbers()
        self.postings: dict[str, list[int]] = {}
        errors, others = exemplars.lines(exemplars.ERRORS), exemplars.lines(exemplars.SCRIPTS + exemplars.FILLER)
        self.n_residue, self.n_errors = len(errors) + len(others), len(errors)
        # an error message may end with its number, whatever it says
        self.number_words = set(words_of(exemplars.NUMBERS))
        for k, line in enumerate(errors + others):
            for w in set(words_of(line)):
                self.postings.setdefault(w, []).append(k)
        self.talk_words = [set(words_of(x)) - {"slot"} for x in exemplars.lines(exemplars.TALK)]
        self.talk: dict[str, list[int]] = {}
        for k, words in enumerate(self.talk_words):
            for w in words:
                self.talk.setdefault(w, []).append(k)
        self.placeholders: dict[str, list[set[str]]] = {}
        for line in exemplars.lines(exemplars.PLACEHOLDERS):
            kinds, names = line.split(" : ")
            for kind in kinds.split():
                self.placeholders.setdefault(kind, []).append(set(names.split()))
        self._seen = 0

    def weight(self, word: str) -> float:
        return float(self.by_bucket[bucket(word)])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each numbered word: weight, whether it counts for coverage, whether it gives the number of an error, first posting and number of postings; and all postings."""
        if self._seen != len(self.numbers.words):
            words = self.numbers.words
            weight = self.by_bucket[np.array(self.numbers.buckets, np.int64)]
            weight[[i for i, w in enumerate(words) if not w]] = 0.0
            counts = np.array([w not in ("", "0") for w in words], bool)
            lists = [self.postings.get(w, ()) for w in words]
            n = np.array([len(x) for x in lists], np.int64)
            gives = np.array([w in self.number_words for w in words], bool)
            self._tables = weight, counts, gives, np.cumsum(n) - n, n, np.array([k for x in lists for k in x], np.int64)
            self._seen = len(words)
        return self._tables

    def forget(self) -> None:
        """Number words anew where too many are remembered."""
        if len(self.numbers.words) > WORDS_KEPT:
            self.numbers, self._seen = _Numbers(), 0

    def _contained(self, start: np.ndarray, end: np.ndarray, ids: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Whether each window (start, end) is contained in a residue exemplar."""
        weight, _, gives, first, n, postings = self.tables()
        size = end - start
        window = np.repeat(np.arange(len(start)), size)
        word = ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        times = n[word]
        at = np.repeat(first[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        places = np.repeat(window, times) * self.n_residue + postings[at]

        def held(x: np.ndarray) -> np.ndarray:
            return np.bincount(places, weights=np.repeat(x[word], times), minlength=len(start) * self.n_residue).reshape(len(start), self.n_residue)

        every, number = held(weight), held(np.where(gives, weight, 0.0))
        whole = every.max(axis=1) >= CONTAINED * total
        # or an error with the number that follows it
        given = np.bincount(window, weights=np.where(gives[word], weight[word], 0.0), minlength=len(start))[:, None]
        core = every[:, : self.n_errors] - number[:, : self.n_errors]
        return whole | ((core + given >= CONTAINED * total[:, None]) & (core >= CORE * total[:, None])).any(axis=1)

    def coverage(self, texts: list[str]) -> np.ndarray:
        """Share of the words of each text in windows contained in residue exemplars; 0 for a text without words or that only gives a number."""
        ids, lengths, of = numbered(texts, self.numbers)
        if not len(ids):
            return np.zeros(len(texts))
        weight, counts, gives, _, n, _ = self.tables()
        summed = [np.concatenate([[0.0], np.cumsum(x)]) for x in (weight[ids], np.where((n[ids] > 0) | gives[ids], weight[ids], 0.0), counts[ids])]
        end = np.cumsum(lengths)
        start = end - lengths
        # lines that only give a number tell nothing by themselves and don't count
        other = np.concatenate([[0], np.cumsum(counts[ids] & ~gives[ids])])
        tells = other[end] > other[start]
        start, end, of = start[tells], end[tells], of[tells]
        words = np.bincount(of, weights=summed[2][end] - summed[2][start], minlength=len(texts))
        covered = np.zeros(len(texts))
        while len(start):
            total, known, _ = (x[end] - x[start] for x in summed)
            able = np.flatnonzero((known >= CONTAINED * total) & (total > 0))
            hit = np.zeros(len(start), bool)
            for some in np.array_split(able, max(1, len(able) // 2_000)):
                if len(some):
                    hit[some] = self._contained(start[some], end[some], ids, total[some])
            np.add.at(covered, of[hit], (summed[2][end] - summed[2][start])[hit])
            half = (end - start) // 2
            split = ~hit & (half >= LEAST_WORDS) & (known > 0)
            middle = start[split] + half[split]
            start, end, of = np.concatenate([start[split], middle]), np.concatenate([middle, end[split]]), np.concatenate([of[split]] * 2)
        return covered / np.maximum(words, 1)

    def held(self, shape: str, name: list[str]) -> float:
        """Largest share of a placeholder's name that an exemplar with its delimiters holds; a slot holds any name."""
        best = 0.0
        for words in self.placeholders.get(shape, ()):
            if "*" in words:
                return 1.0
            total = sum(map(self.weight, name))
            if total > 0:
                best = max(best, sum(self.weight(w) for w in name if w in words) / total)
        return best

    def is_talk(self, words: list[str]) -> bool:
        words = [w for w in words if w != "slot"]
        held: dict[int, float] = {}
        for w in words:
            for k in self.talk.get(w, ()):
                held[k] = held.get(k, 0.0) + self.weight(w)
        total, mine = sum(map(self.weight, words)), set(words)
        for k, x in held.items():
            if x >= TALK * total:
                theirs = self.talk_words[k]
                if sum(self.weight(w) for w in theirs & mine) >= TALK_BACK * sum(map(self.weight, theirs)):
                    return True
        return False

    def open_slots(self, text: str) -> int:
        """Placeholders that stand where a value should stand."""
        found = [x for x in slots(text) if self.held(x[2], x[3]) >= SLOT]
        if not found:
            return 0
        out, at = [], 0
        for begin, end, _, _ in found:
            out += text[at:begin], " slot "
            at = end
        marked = "".join(out) + text[at:]
        sentences = (words_of(x) for x in _SENTENCE.split(_URL.sub(" ", marked)))
        return sum(w.count("slot") for w in sentences if "slot" in w and not self.is_talk(w))


def are_residue(subjects: list[str | None], own: list[str], openings: list[str | None], index: Index) -> np.ndarray:
    """Whether each message is a case. opening: the part of ``own`` above the first quote, if that isn't all. It is surely the
    sender's, while lines below may have lost their quote mark, so a message is residue if either of the two is."""
    share = index.coverage(own)
    also = np.array([i for i, x in enumerate(openings) if x], np.int64)
    if len(also):
        share[also] = np.maximum(share[also], index.coverage([openings[i] for i in also]))
    found = share >= COVERED
    for i in np.flatnonzero(~found):
        found[i] = index.open_slots(html.unescape(subjects[i] or "")) > 0 or index.open_slots(own[i]) > 0
    index.forget()
    return found


def own_text(text: str) -> tuple[str | None, str, str | None]:
    """The subject and the newly written text, a line for each paragraph, and what of it stands above the first quote if that isn't all."""
    subject, parts = mail.text_parts(text)
    own = "\n".join(mail.passages(mail.own_lines(parts)))
    opening = "\n".join(mail.passages(mail.own_lines(parts, False))) if mail.quotes_in_line(parts) else own
    return subject, own, opening if opening != own else None


_MESSAGE = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("own", pa.string()), ("opening", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def parsed(documents: DataFrame) -> DataFrame:
    """(doc_id, subject, own, opening) of documents with a text that isn't null; and, in rows with a bucket, in how many of the
    new texts of a task words of each bucket occur, as (bucket, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        numbers = _Numbers()
        for batch in batches:
            found = [own_text(t) for t in batch.column(1).to_pylist()]
            none = pa.nulls(len(found))
            columns = [batch.column(0), *(pa.array([x[k] for x in found], pa.string()) for k in range(3)), none.cast(pa.int32()), none.cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_MESSAGE)
            own = [x[1] for x in found]
            for some in blocks(own):
                ids, lengths, of = numbered(own[some], numbers)
                if len(ids):
                    pairs = np.unique(np.repeat(of, lengths) * BUCKETS + np.array(numbers.buckets, np.int64)[ids])
                    total += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
                if len(numbers) > WORDS_KEPT:
                    numbers = _Numbers()
        at = np.flatnonzero(total)
        if len(at):
            none = pa.nulls(len(at))
            columns = [none.cast(pa.int64()), *(none.cast(pa.string()) for _ in range(3)), pa.array(at.astype(np.int32)), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(columns, schema=_MESSAGE)

    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(rows).mapInArrow(work, "doc_id bigint, subject string, own string, opening string, bucket int, n bigint")


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of ``documents(doc_id, text)`` that carry residue in place of content.

    Null, empty and blank texts, and messages without new text or placeholder, are no case.
    Texts are taken whole. Weights come from the newly written text of all documents; their
    table has at most BUCKETS entries. A repeated doc_id is given once for each row that is a
    case; extra columns are ignored.
    """
    rows = materialize(parsed(documents), "messages")
    frequency = np.zeros(BUCKETS, np.int64)
    for b, n in rows.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[b] = n
    messages = rows.where("bucket is null").select("doc_id", "subject", "own", "opening")
    count = messages.count()
    shared = messages.sparkSession.sparkContext.broadcast((frequency, count))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            subject, own, opening = (batch.column(k).to_pylist() for k in (1, 2, 3))
            case = [are_residue(subject[x], own[x], opening[x], index) for x in blocks(own)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(np.concatenate(case)))], names=["doc_id"])

    return spread(messages, -(-count // MESSAGES_PER_TASK)).mapInArrow(work, "doc_id bigint")
