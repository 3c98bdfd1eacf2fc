"""Answers that are no usable answer, with the kind of their defect."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.session import ship

DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")

#: Labelled texts per language in a sample; p4 fits on all.
LANGUAGE_ROWS = 250
#: Sound answers with and without headings in a sample; p4 fits on all.
END_ROWS = 1200
#: Share of an answer's word triples that stand in the prompt from which it is a copy.
COPY_SHARE = 0.6
#: Letters an answer needs for a verdict on its language, and log-likelihood gain per letter.
LEAST_LETTERS, LANGUAGE_GAIN = 25, 0.05
#: An answer is truncated if texts end, where its last symbols stand, less often than this.
END_CHANCE = 0.02
BUCKETS = 1 << 16
#: What each bucket of a language has beforehand, as a share of its trigrams, so that strange words weigh the same however many texts there are; 0.1 at least.
SMOOTH = 6e-7
#: Last symbols that a task counts at once.
HELD = 500_000
END_SYMBOLS = 5
ANY = "any"

_HEADING = re.compile(r"^[^\S\n]*(?:\*\*([^*\n]{1,60})\*\*:?|\[([^\]\n]{1,60})\]:?|#{1,6}[^\S\n]*([^\n]{0,60}))[^\S\n]*$", re.M)
#: Whether a text has a heading, as the engine's own pattern.
HEADED = r"(?m)^[\s&&[^\n]]*(?:\*\*[^*\n]{1,60}\*\*:?|\[[^\]\n]{1,60}\]:?|#{1,6}[^\n]{0,60})[\s&&[^\n]]*$"
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|```\w*|&#?\w{1,10};")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힣]|[^\W_぀-ヿ㐀-鿿가-힣]+")
_QUOTED = re.compile(r"“[^”]{0,400}”|„[^“”]{0,400}[“”]|«[^»]{0,400}»|\"[^\"\n]{0,400}\"")
#: Words that alone say nothing.
NOTHING = frozenset("n a na none null nil nan empty blank tbd todo undefined nothing void no content text answer response output unknown".split())
#: Phrases that decline a task by themselves.
_DECLINE = re.compile(
    r"\bas an? (?:ai|artificial|language|large language)|\bi (?:must|have to) (?:decline|pass|refuse)\b|\bi (?:decline|refuse) to\b|\bi(?: would|['’]d) (?:rather|prefer) not\b"
    r"|\b(?:not (?:be )?appropriate|inappropriate) for me\b|\b(?:outside|beyond) (?:of )?(?:what i|my)\b|\bmy (?:guidelines|policy|policies|instructions)\b"
    r"|\bi(?: am|['’]m) not (?:in a position|allowed|permitted)\b|\bdo(?: not|n['’]t) have the ability\b"
    r"|\bals (?:sprachmodell|ki)|nicht helfen|\bablehnen\b|\ben tant que (?:modèle|ia)|\bje (?:dois|préfère) (?:refuser|décliner|ne)"
    r"|\bcomo (?:modelo|ia)\b|\bdebo (?:declinar|rechazar)|\bprefiero no|\bprefiro não"
    r"|как (?:языковая|ии)|вынужден|いたしかねます|お手伝い|言語モデル|お断り",
    re.I | re.S,
)
#: Phrases that decline if the same words name the task.
_CANNOT = re.compile(
    r"\bi(?: am|['’]m)? (?:cannot|can ?not|can['’]t|won['’]t|will not|unable|not able)\b|\bi(?: am|['’]m) (?:unable|not able|sorry|afraid)\b|\bi (?:apologi[sz]e|regret)\b|^\W*(?:sorry|unfortunately)\b"
    r"|\b(?:tut mir leid|leider|(?:kann|darf|werde|möchte) ich\b.{0,60}\b(?:nicht|keine?n?))\b"
    r"|\bdésolée?|\bje (?:ne|n['’])\s*(?:peux|suis|puis|saurais|ai)|\blo siento|\b(?:no|não) (?:puedo|posso|podré|poderei)|\blamento|\bdesculpe|\bsinto muito"
    r"|извините|к сожалению|не могу|申し訳|すみません|できません",
    re.I | re.S,
)
#: What an answer is asked to do.
_TASK = re.compile(
    r"\b(?:turn (?:this|that|it) into|help|assist|write|answer|respond|comply|draft|compose|fulfil|fulfill|discuss)\b|\b(?:this|that|these|those|such|your|the) (?:requests?|tasks?|requested|reports?|sections?|texts?|content|answers?)\b"
    r"|\b(?:hel(?:f|p)en|schreiben|verfassen|erstellen|beantworten|ausfüllen|anfertigen|formulieren|übernehmen)\b"
    r"|\b(?:aider|écrire|rédiger|répondre|fournir|remplir|produire|traiter)\b|\b(?:ayudar|escribir|redactar|responder|proporcionar|completar|rellenar|generar|ajudar|escrever|redigir|preencher|atender)\w*"
    r"|помочь|написать|ответить|составить|выполнить|書|作成|対応|回答|応じ|手伝",
    re.I,
)
_SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|[。！？]+|\n+")
#: A symbol with a line end, or a blank and a capital, behind it.
_STOP = re.compile(r"[^\s](?=\n| A)")
_SYMBOL = re.compile(r"[^\W\d_]+|\d+|\n+|[^\S\n]+|.", re.S)


def plain(text: str) -> str:
    """The text without headings, markup and characters that don't show."""
    return _HEADING.sub(" ", _INVISIBLE.sub("", _TAG.sub(" ", text)))


def triples(text: str) -> set[tuple[str, ...]]:
    words = [w.lower() for w in _WORD.findall(text)]
    n = 3 if len(words) >= 3 else max(1, len(words))
    return set(zip(*(words[i:] for i in range(n))))


def says_nothing(text: str | None) -> bool:
    if text is None:
        return True
    words = _WORD.findall(plain(text).lower())
    return all(w in NOTHING for w in words)


def sections_of(text: str) -> list[str]:
    """What stands before, between and after the headings, without markup and quotations; empty pieces are left out."""
    cuts = [0]
    for m in _HEADING.finditer(text):
        cuts += m.span()
    cuts.append(len(text))
    pieces = (_QUOTED.sub(" ", plain(text[a:b])).strip() for a, b in zip(cuts[::2], cuts[1::2]))
    return [p for p in pieces if _WORD.search(p)]


def opening(text: str) -> str:
    """The first two sentences."""
    ends = [m.end() for _, m in zip(range(2), _SENTENCE_END.finditer(text))]
    return text[: ends[-1]] if len(ends) == 2 else text


def declines(text: str) -> bool:
    """Whether every section of the answer opens by declining the task; one that delivers anything makes it an answer.

    However long the answer is: only openings count, so that a report may say further on what
    its writer cannot do.
    """
    sections = sections_of(text)
    return bool(sections) and all(_DECLINE.search(first) or (_CANNOT.search(first) and _TASK.search(first)) for first in map(opening, sections))


def copies(prompt: str | None, text: str) -> bool:
    if not prompt:
        return False
    own = triples(plain(html.unescape(text)))
    if not own:
        return False
    theirs = triples(plain(html.unescape(prompt)))
    # no need to build on typing errors: each spoils three triples at most
    return len(own & theirs) >= COPY_SHARE * len(own) and len(own & theirs) >= 0.3 * len(theirs)


class Languages:
    """Naive Bayes over hashed character trigrams."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        self.fit(self.tally(texts))

    @classmethod
    def of_counts(cls, counted: dict[str, np.ndarray]) -> Languages:
        """The model of the trigram counts of each language."""
        self = cls.__new__(cls)
        self.fit(counted)
        return self

    @classmethod
    def tally(cls, texts: Iterable[tuple[str, str]]) -> dict[str, np.ndarray]:
        """How often each bucket of trigrams occurs in each language."""
        counted: dict[str, np.ndarray] = {}
        for name, text in texts:
            own = counted.setdefault(name, np.zeros(BUCKETS, np.int64))
            np.add.at(own, cls.grams(letters(text))[0], 1)
        return counted

    def fit(self, counted: dict[str, np.ndarray]) -> None:
        self.names = sorted(counted)
        counts = np.ones((BUCKETS, max(1, len(self.names))), np.float64)
        for k, name in enumerate(self.names):
            counts[:, k] = counted[name] + max(0.1, SMOOTH * counted[name].sum())
        self.table = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    @staticmethod
    def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each trigram of ``text``, and its code points."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        if len(points) < 3:
            return np.zeros(0, np.int64), points
        h = points[:-2] * 40503 + points[1:-1] * 9973 + points[2:] * 137
        return (h ^ (h >> 16)) & (BUCKETS - 1), points

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood per text and language, letters per text), all texts at once."""
        bodies = [letters(t) for t in texts]
        joined = "\x00".join(bodies) + "\x00\x00\x00"
        buckets, points = self.grams(joined)
        starts = np.concatenate(([0], np.cumsum([len(b) + 1 for b in bodies])[:-1])).astype(np.int64)
        inside = np.ones(len(buckets), bool)
        ends = np.flatnonzero(points == 0)
        for back in range(3):
            at = ends - back
            inside[at[(at >= 0) & (at < len(buckets))]] = False
        scores = self.table[buckets] * inside[:, None]
        sums = np.add.reduceat(scores, np.minimum(starts, len(scores) - 1), axis=0) if len(texts) else np.zeros((0, 1))
        return sums, np.array([len(b) for b in bodies])


_NON_LETTERS = re.compile(r"https?://\S+|\S*[\d_/\\@:<>{}=]\S*|[^\w\s'’]+")
_SPACES = re.compile(r"\s+")


def letters(text: str) -> str:
    """The running words of a text in lower case: no headings, markup, paths, numbers or punctuation."""
    return f" {_SPACES.sub(' ', _NON_LETTERS.sub(' ', plain(text).lower())).strip()} "


def heading_kind(name: str) -> str:
    """What the section of a heading is about."""
    low = name.lower()
    for kind in ("step", "repro", "expect", "actual", "environment", "platform", "version", "regress", "note", "evidence", "summary"):
        if kind in low:
            return {"repro": "step", "platform": "environment", "version": "environment"}.get(kind, kind)
    return "other"


class _Kinds(dict):
    """The symbol of what begins with a character."""

    def __missing__(self, c: str) -> str:
        self[c] = kind = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else "\n" if c == "\n" else " " if c.isspace() else c
        return kind


_KINDS = _Kinds()


def symbols(text: str) -> list[str]:
    """The text as coarse symbols: words, capital words, numbers, line ends, blanks, other characters."""
    return [_KINDS[s[0]] for s in _SYMBOL.findall(text)]


def section_of(text: str) -> str:
    """Last heading's kind and whether a code fence is open."""
    last = None
    for last in _HEADING.finditer(text):
        pass
    kind = heading_kind(last[1] or last[2] or last[3] or "") if last else "none"
    return kind + ("`" if text.count("```") % 2 else "")


class Endings:
    """How often texts end after given last symbols within a given section.

    In running text without sections, which may stop after any sentence, the ends of sentences
    count as well: a mark with a line end, or a blank and a capital, behind it. Where the sample
    has no running text, the sentences of all sections stand in for it.
    """

    def __init__(self, texts: list[str]) -> None:
        self.fit((*key, *n) for key, n in self.merged((*key, *n) for key, n in self.tally(texts).items()).items())

    @classmethod
    def of_counts(cls, rows: Iterable[tuple[str, str, int, int, int]]) -> Endings:
        """The model of the merged counts of all texts."""
        self = cls.__new__(cls)
        self.fit(rows)
        return self

    @staticmethod
    def tally(texts: Iterable[str]) -> dict[tuple[str, str], list[int]]:
        """(section, last symbols) -> [seen, of these at an end of sentence, at the end of a text]."""
        seen_in: dict[str, Counter] = {}
        stops: Counter = Counter()
        finals: Counter = Counter()
        for text in texts:
            text = text.strip()
            cuts = [0, *(m.end() for m in _HEADING.finditer(text)), len(text)]
            for a, b in zip(cuts, cuts[1:]):  # one part for each section, after its heading
                kind = section_of(text[:a]).rstrip("`") if a else "none"
                fences = text[:a].count("`")
                tail = "".join(symbols(text[max(0, a - 40) : a])[-END_SYMBOLS:])
                whole = tail + "".join(symbols(text[a:b]))  # one character for each symbol
                where = []
                for i in range(len(tail), len(whole) + 1) if fences or "`" in whole[len(tail) :] else ():
                    fences += i > len(tail) and whole[i - 1] == "`"
                    where.append(kind + "`" * (fences // 3 % 2))
                for n in range(1, END_SYMBOLS + 1):
                    last = [whole[max(0, i - n) : i] for i in range(len(tail), len(whole) + 1)]
                    if where:
                        for w, x in zip(where, last):
                            seen_in.setdefault(w, Counter())[x] += 1
                    else:
                        seen_in.setdefault(kind, Counter()).update(last)
                for m in _STOP.finditer(whole, len(tail)):
                    i = m.end()
                    if not whole[i - 1].isalnum():
                        at = where[i - len(tail)] if where else kind
                        stops.update((at, whole[max(0, i - n) : i]) for n in range(1, END_SYMBOLS + 1))
            final = "".join(symbols(text[-200:]))
            if final:
                finals.update((section_of(text), final[-n:]) for n in range(1, END_SYMBOLS + 1))
        seen = {(w, x): n for w, counted in seen_in.items() for x, n in counted.items()}
        return {k: [seen.get(k, 0), stops[k], finals[k]] for k in seen.keys() | finals.keys()}

    @staticmethod
    def merged(rows: Iterable[tuple[str, str, int, int, int]]) -> dict[tuple[str, str], list[int]]:
        """The counts of all rows, and beside them those of any section with a heading."""
        out: dict[tuple[str, str], list[int]] = {}
        for where, last, *n in rows:
            for at in (where,) if where.startswith("none") else (where, ANY):
                out[at, last] = [x + y for x, y in zip(out.get((at, last), (0, 0, 0)), n)]
        return out

    def fit(self, rows: Iterable[tuple[str, str, int, int, int]]) -> None:
        """Chances of the merged counts; last symbols that were seen less than 8 times count only if a text ends there."""
        self.chance: dict[tuple[str, str], float] = {}
        self.running = False
        for where, last, seen, stops, finals in rows:
            ends = stops if where == ANY else finals + stops if where.startswith("none") else finals
            if seen and (seen >= 8 or ends):
                self.chance[where, last] = ends / seen
            self.running |= where == "none" and finals > 0

    def of(self, text: str) -> float:
        """The chance that a text ends where this one does."""
        text = text.strip()
        final = symbols(text[-200:])
        where = section_of(text)
        if where == "none" and not self.running:
            where = ANY
        for n in range(END_SYMBOLS, 0, -1):
            c = self.chance.get((where, "".join(final[-n:])))
            if c is not None:
                return c
        return 0.0


def classify(prompts: list[str | None], answers: list[str | None], languages: Languages, endings: Endings) -> list[str | None]:
    """The first defect that holds of each answer, or None."""
    out: list[str | None] = [None] * len(answers)
    left: list[int] = []
    for i, (prompt, answer) in enumerate(zip(prompts, answers)):
        if says_nothing(answer):
            out[i] = "empty"
        elif declines(answer):
            out[i] = "refusal"
        elif copies(prompt, answer):
            out[i] = "copy"
        else:
            left.append(i)
    if not left:
        return out
    own, size = languages.likelihoods([answers[i] for i in left])
    asked, asked_size = languages.likelihoods([prompts[i] or "" for i in left])
    for row, i in enumerate(left):
        a, p = int(own[row].argmax()), int(asked[row].argmax())
        enough = min(size[row], asked_size[row]) >= LEAST_LETTERS
        if enough and a != p and own[row, a] - own[row, p] > LANGUAGE_GAIN * size[row] and asked[row, p] - asked[row, a] > LANGUAGE_GAIN * asked_size[row]:
            out[i] = "other_language"
        elif endings.of(answers[i]) < END_CHANCE:
            out[i] = "truncated"
    return out


def language_name(lang: Column) -> Column:
    """Two-letter code of a language label in any spelling, or null."""
    code = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(code != "", code)


def language_sample(documents: DataFrame, rows: int = LANGUAGE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` whole labelled texts of each language for fitting, chosen by hash.

    A label with few texts stays; smoothing keeps its model vague.
    """
    order = Window.partitionBy("l").orderBy("h", "t")
    picked = (
        documents.select(language_name(F.col("lang")).alias("l"), F.col("text").alias("t"), F.xxhash64("doc_id").alias("h"))
        .where("l is not null and length(t) >= 80")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= rows)
    )
    return [(r.l, r.t) for r in picked.select("l", "t").collect()]  # at most rows of each language


def ending_sample(sound: DataFrame, rows: int = END_ROWS) -> list[str]:
    """At most ``rows`` sound answers with headings and as many without, for fitting, chosen by hash.

    A first cut at about four times as many different texts keeps what the tasks hand on as
    small as the sample.
    """
    headed = F.col("text").rlike(HEADED)
    known = sound.where("length(text) >= 80").withColumn("headed", headed)
    different = {r.headed: r.n for r in known.groupBy("headed").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    share = F.lit(1.0)
    for kind, n in different.items():
        share = F.when(F.col("headed") == kind, min(1.0, 4.0 * rows / max(1, n))).otherwise(share)
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    few = known.where(mark < share * float(1 << 30)).select("headed", "text").distinct()
    order = Window.partitionBy("headed").orderBy(F.xxhash64("text"), "text")
    return [r.text for r in few.withColumn("i", F.row_number().over(order)).where(F.col("i") <= rows).select("text").collect()]


def all_languages(documents: DataFrame) -> Languages:
    """The language model of all labelled texts: trigrams are counted where the texts lie, only counts are shuffled."""
    ship(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, own in Languages.tally(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())).items():
                counted[name] = counted.get(name, 0) + own
        packed = [zlib.compress(c.astype("<i8").tobytes(), 1) for c in counted.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(packed, pa.binary())], ["l", "counts"])

    def add(found: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for c in found.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), "<i8")
        return pa.table({"l": pa.array([found.column("l")[0].as_py()], pa.string()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    labelled = documents.select(language_name(F.col("lang")).alias("l"), F.col("text").alias("t")).where("l is not null and length(t) >= 80")
    schema = "l string, counts binary"
    rows = labelled.mapInArrow(count, schema).groupBy("l").applyInArrow(add, schema).collect()  # a table of fixed size for each language
    return Languages.of_counts({r.l: np.frombuffer(zlib.decompress(r.counts), "<i8") for r in rows})


def all_endings(sound: DataFrame) -> Endings:
    """The end-of-text model of all different sound answers; what is collected are the last symbols that its rule keeps."""
    ship(sound.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for key, n in Endings.tally(batch.column(0).slice(at, 500).to_pylist()).items():
                    old = counted.get(key)
                    counted[key] = [x + y for x, y in zip(old, n)] if old else n
                if len(counted) > HELD:
                    yield packed(counted)
                    counted = {}
        yield packed(counted)

    def packed(counted: dict[tuple[str, str], list[int]]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in counted], pa.string()) for i in (0, 1)] + [pa.array([n[i] for n in counted.values()], pa.int64()) for i in (0, 1, 2)]
        return pa.RecordBatch.from_arrays(columns, ["at", "last", "seen", "stops", "finals"])

    different = sound.where("length(text) >= 80").select("text").distinct()
    rows = different.mapInArrow(count, "at string, last string, seen bigint, stops bigint, finals bigint")
    either = F.when(F.col("at").startswith("none"), F.array("at")).otherwise(F.array("at", F.lit(ANY)))
    merged = rows.withColumn("at", F.explode(either)).groupBy("at", "last").agg(*[F.sum(c).alias(c) for c in ("seen", "stops", "finals")])
    return Endings.of_counts(tuple(r) for r in merged.where("seen >= 8 or stops > 0 or finals > 0").collect())


def find(answers: DataFrame, languages: Languages, endings: Endings) -> DataFrame:
    """(origin, record_id, defect) of every defective record of ``answers``.

    ``answers`` has origin, record_id, prompt, answer and at. Each row is judged where it
    lies, only the verdicts are shuffled; of a repeated record the latest row counts. A null
    answer is empty; with a null or blank prompt only empty, refusal and truncated can hold.
    """
    spark = answers.sparkSession
    ship(spark)
    models = spark.sparkContext.broadcast((languages, endings))  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = models.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = classify(part.column(3).to_pylist(), part.column(4).to_pylist(), *fitted)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(found, pa.string())], ["origin", "record_id", "at", "defect"]
                )

    judged = answers.where("record_id is not null").select("origin", "record_id", "at", "prompt", "answer").mapInArrow(
        run, "origin string, record_id bigint, at timestamp, defect string"
    )
    latest = judged.groupBy("origin", "record_id").agg(F.max(F.struct("at", F.coalesce("defect", F.lit("")).alias("defect"))).alias("r"))
    return latest.where("r.defect <> ''").select("origin", "record_id", F.col("r.defect").alias("defect"))
