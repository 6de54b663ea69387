"""Reading level of texts: the median of classic grade formulas.

Sentences are found whatever the layout: quote marks, bullets, numbering and speakers at the start of a line are taken
off, headings and links dropped. A line break ends a sentence unless the line ends in a comma or the like, or the block
is wrapped: no line could have taken the next line's first word, or lines have one number of words, or sentences end
within lines only. Syllables are counted by hyphenation-style rules, once for each distinct word of a process.

The formulas' sentence length is that of the sentence which a text's middle word stands in, when sentences are ordered
by length; the plain mean is not used, as headings, signatures and list entries pull it down.

The language is told by profiles of letter trigrams, fitted on a bounded sample of documents with a language label. A
text that is unlikely under the best profile, too, is in none of the languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.storage import Scratch

LANGUAGES = ("en", "de", "fr", "es")
#: Labelled documents that the profiles are fitted on, at most.
PROFILE_DOCUMENTS = 4_000
#: Texts of the sample from which the spread of a language is taken, at least.
LEAST_TEXTS = 10
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LINK = re.compile(r"https?://\S+|www\.\S+|<[^<>\n]{1,80}>")
_ADDRESS = re.compile(r"\S+@\S+\.\S+")
# Characters without width, and the soft hyphen.
_HIDDEN = re.compile("[" + "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))) + "]")
_LEAD = re.compile(r"^[\s>]*(?:(?:[-*•+]|\d{1,3}[.)])\s+)*(?:[A-Z]{1,2}\d{1,2}:\s*)?")
_SPEAKER = re.compile(r"^[\s>]*[A-Z]{1,2}\d{1,2}:")
_OPEN_END = re.compile(r"[,;:(\[–—-][\"'”’*_]*$")
_END = re.compile(r"[.!?…]+[\"'”’)\]*_]*(?=\s|$)")
_FULL_END = re.compile(r"[.!?…]+[\"'”’)\]*_]*$")
_PAUSE = re.compile(r"[,;:()–—]")
_VOWELS = re.compile(r"(?:[aeiouàâäáéèêëíîïóôöúùûüœæ]|y(?![aeiou]))+")
# Letters between which, or after which, a syllable more begins than the vowel groups tell.
_PARTED = re.compile(
    r"i(?=[aou])|i(?=et)|e(?=o(?!pl|pard|us))|u(?=a)|a(?=o)|[aeo](?=ing$)|(?<![qg])u(?=en|el|ou)|o(?=e[mt])|(?<=cr)e(?=at)|(?<=sc)i(?=en)|e(?=um)|(?<=na)i(?=v)"
    r"|(?<=r)e(?=ali|act|in[ftv])|(?<=c)o(?=oper|ord)|(?<=zo)o(?=l)|is(?=m)|th(?=ms?$)"
)
# Endings whose vowels are one syllable after all.
_MELTED = re.compile(r"[ts]io(?=n)|[cts]ia(?=[ln])|[ctg]io(?=us)|(?<=l)lio(?=n)|[ngh]io(?=n)|[qg]ua|sch?ie(?=ntious)|consci(?=en)")
#: A run of words without any mark is one sentence up to so many words; beyond, so many words more are one more.
RUN_ON, PLAIN_SENTENCE = 40, 12
_KNOWN: dict[str, tuple[int, int]] = {}


def _measure(word: str) -> tuple[int, int]:
    """Letters and syllables of a word, kept for the next time."""
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    _KNOWN[word] = len(word) - word.count("'") - word.count("’"), syllables(word)
    return _KNOWN[word]


def syllables(word: str) -> int:
    """Vowel groups, less silent endings, plus the places where a group is parted and less those where an ending is one; 1 at least."""
    w = word.replace("’", "'").removesuffix("'s")
    n = len(_VOWELS.findall(w))
    if w.endswith("e") and not w.endswith(("le", "ee", "oe")) or w.endswith("le") and len(w) > 2 and w[-3] in "aeiouy":
        n -= 1
    elif w.endswith("es") and len(w) > 3 and w[-3] not in "sxzhcgaeiou" and not w.endswith("les"):
        n -= 1
    elif w.endswith("ed") and len(w) > 3 and w[-3] not in "tdaeiouy":
        n -= 1
    if w.endswith("ea") and n > 1:
        n += 1
    return max(1, n + len(_PARTED.findall(w)) - len(_MELTED.findall(w)))


def _wrapped(lines: list[str]) -> bool:
    """Whether a block's line breaks mean nothing: lines of a fixed width or number of words, or sentences that end within lines only."""
    ends = sum(bool(_FULL_END.search(x)) for x in lines)
    inside = sum(len(_END.findall(x)) for x in lines) - ends
    pauses = sum(len(_PAUSE.findall(x)) for x in lines)
    if len(lines) < 2 or not ends + inside or not inside and pauses < 0.4 * len(lines):  # lines are all there is
        return False
    width = max(map(len, lines))
    if len(lines) > 2 and width >= 20 and sum(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in zip(lines, lines[1:], strict=False)) >= 0.9 * (len(lines) - 1):
        return True
    counts = [len(x.split()) for x in lines[:-1]]
    if len(lines) > 3 and counts.count(max(set(counts), key=counts.count)) >= 0.8 * len(counts):
        return True
    return inside > 0 and ends - bool(_FULL_END.search(lines[-1])) < 0.2 * inside and not all(x[:1].isupper() for x in lines)


def sentences(text: str) -> list[tuple[list[str], float]]:
    """The words of each sentence, in lower case, and for how many sentences they count (1, but for a run-on)."""
    text = _LINK.sub(" ", text) if "<" in text or "http" in text or "www." in text else text
    text = _ADDRESS.sub(" ", text) if "@" in text else text
    text = text if text.isascii() else _HIDDEN.sub("", text)
    blocks: list[list[tuple[str, bool]]] = [[]]
    for line in text.splitlines():
        bare = line.strip()
        if not bare.strip("> "):
            blocks.append([])
        elif bare.startswith("#"):
            blocks.append([])
        else:
            blocks[-1].append((" ".join(_LEAD.sub("", line).split()), bool(_SPEAKER.match(line))))
    parts: list[str] = []
    for block in blocks:
        lines = [x for x in block if x[0]]
        soft = _wrapped([x for x, _ in lines])
        joined = ""
        for bare, speaker in lines:
            if joined and not speaker and (soft or _OPEN_END.search(joined)):
                joined += " " + bare
            else:
                if joined:
                    parts.append(joined)
                joined = bare
        if joined:
            parts.append(joined)
    found = []
    for part in parts:
        start, low = 0, part.lower()
        for end in [*(m.end() for m in _END.finditer(low)), len(low)]:
            piece = low[start:end]
            start = end
            words = _TOKEN.findall(piece)
            if not words:
                continue
            run_on = len(words) > RUN_ON and not _PAUSE.search(piece)
            found.append((words, 1 + (len(words) - RUN_ON) / PLAIN_SENTENCE if run_on else 1.0))
    return found


def counted(found: list[tuple[list[str], float]]) -> Counter:
    """How often each word occurs."""
    counts: Counter = Counter()
    for words, _ in found:
        counts.update(words)
    return counts


def grades(found: list[tuple[list[str], float]], counts: Counter | None = None) -> dict[str, float]:
    """School grades by six formulas; none for a text without words."""
    counts = counted(found) if counts is None else counts
    n = letters = total = hard = long_ = 0
    for word, k in counts.items():
        size = _KNOWN.get(word) or _measure(word)
        n += k
        letters += size[0] * k
        total += size[1] * k
        hard += k if size[1] >= 3 else 0
        long_ += k if size[0] > 6 else 0
    if not n:
        return {}
    per, upto = 0.0, 0
    for length, size in sorted((len(words) / parts, len(words)) for words, parts in found):
        per, upto = length, upto + size
        if 2 * upto >= n:  # the middle word's sentence
            break
    n_sentences = n / per
    # The published coefficients of the formulas.
    return {
        "flesch_kincaid": 0.39 * per + 11.8 * total / n - 15.59,
        "gunning_fog": 0.4 * (per + 100 * hard / n),
        "smog": 1.043 * math.sqrt(30 * hard / n_sentences) + 3.1291,
        "automated": 4.71 * letters / n + 0.5 * per - 21.43,
        "coleman_liau": 5.88 * letters / n - 29.6 * n_sentences / n - 15.8,
        "lix_grade": (per + 100 * long_ / n) / 4 - 3,
    }


def _trigrams(word: str) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + 3] for i in range(len(word) - 2)]


class Profile:
    """Logarithmic chances of letter trigrams in each language, and the least mean of a text that is in it."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.names = sorted(counts)
        every = sorted({t for c in counts.values() for t in c})
        totals = [sum(counts[x].values()) + 0.5 * (len(every) + 1) for x in self.names]
        self.unseen = tuple(math.log(0.5 / n) for n in totals)
        self.chances = {t: tuple(math.log((counts[x].get(t, 0) + 0.5) / n) for x, n in zip(self.names, totals, strict=True)) for t in every}
        self.floors = dict.fromkeys(self.names, -math.inf)
        self._words: dict[str, tuple[float, ...]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_words": {}}

    def _word(self, word: str) -> tuple[float, ...]:
        """The number of trigrams of a word and their sum in each language, kept for the next time."""
        if len(self._words) > 500_000:
            self._words.clear()
        found = _trigrams(word)
        sums = (sum(x) for x in zip(*(self.chances.get(t, self.unseen) for t in found), strict=True))
        self._words[word] = (len(found), *sums)
        return self._words[word]

    def best(self, counts: Counter) -> tuple[str, float] | None:
        """The likeliest language and the mean over a text's trigrams; None for a text without words."""
        if not self.names or not counts:
            return None
        sums = [0.0] * (len(self.names) + 1)
        for word, k in counts.items():
            for i, x in enumerate(self._words.get(word) or self._word(word)):
                sums[i] += k * x
        mean, name = max((x / sums[0], name) for x, name in zip(sums[1:], self.names, strict=True))
        return name, mean

    def language(self, counts: Counter) -> str | None:
        found = self.best(counts)
        return found[0] if found and found[1] >= self.floors[found[0]] else None


def language_profile(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", languages: tuple[str, ...] = LANGUAGES, most: int = PROFILE_DOCUMENTS) -> Profile:
    """Profiles of at most ``most`` documents labelled with one of ``languages``, drawn by a hash.

    A language's floor is five standard deviations below the mean of the sample's texts that are likeliest in it, or
    the least of them if that is lower; a language of fewer than ``LEAST_TEXTS`` such texts has none, as their spread is
    not known. Rows with a null text or another label are left out; without rows there is no
    language.
    """
    scratch = Scratch(documents.sparkSession, "language-profile")
    rows = documents.where(F.col(lang).isin(*languages)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    rows = rows.where("text is not null")
    cut = rows.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    sample = scratch.write(rows.where(F.col("h") <= F.lit(cut).cast("long")).limit(most).select("lang", "text"), "sample").repartition(16)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, k in counted(sentences(t)).items():
                    for x in _trigrams(word):
                        counts[name, x] += k
            columns = ([x[0] for x in counts], [x[1] for x in counts])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(counts.values()), pa.int64())], names=["lang", "t", "n"])

    table: dict[str, dict[str, int]] = {}
    for r in sample.mapInArrow(tally, "lang string, t string, n long").groupBy("lang", "t").agg(F.sum("n").alias("n")).collect():  # trigrams of the sample
        table.setdefault(r["lang"], {})[r["t"]] = r["n"]
    profile = Profile(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in (profile.best(counted(sentences(t))) for t in batch.column(0).to_pylist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "mean"])

    least = F.least(F.min("mean"), F.avg("mean") - 5 * F.coalesce(F.stddev("mean"), F.lit(0.0)))
    long_enough = sample.where(F.length("text") >= 100).select("text")
    for r in long_enough.mapInArrow(score, "lang string, mean double").groupBy("lang").agg(least.alias("least"), F.count("*").alias("n")).collect():
        if r["n"] >= LEAST_TEXTS:
            profile.floors[r["lang"]] = r["least"]
    return profile


def _levels(profile: Profile | None):
    names = ("flesch_kincaid", "gunning_fog", "smog", "automated", "coleman_liau", "lix_grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(names) + 4)]
            for text in batch.column(1).to_pylist():
                found = sentences(text or "")
                counts = counted(found)
                by = grades(found, counts)
                language = profile.language(counts) if profile else None
                values = [*(by.get(x) for x in names), median(by.values()) if by else None, language, len((text or "").split()), len(found)]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = [pa.float64()] * (len(names) + 1) + [pa.string(), pa.int64(), pa.int64()]
            columns = (pa.array(c, t) for c, t in zip(out, types, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", *names, "grade", "language", "n_words", "n_sentences"])

    return run


def reading_levels(documents: DataFrame, key: str = "doc_id", text: str = "text", profile: Profile | None = None) -> DataFrame:
    """``key``, six grade estimates, their median grade, language (null without a profile), n_words and n_sentences of every row.

    A null, empty or wordless text has null grades and language. Rows stay where they are read; keys may be null or
    repeated; other columns are ignored.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, flesch_kincaid double, gunning_fog double, smog double, automated double, coleman_liau double, lix_grade double, grade double, language string, n_words long, n_sentences long"
    return rows.mapInArrow(_levels(profile), schema).withColumnRenamed("key", key)


#: Labelled samples the threshold is fitted on, at most.
SAMPLES = 10_000


def demanding_from(samples: DataFrame, text: str = "text", grade: str = "grade", least: int = 4) -> float:
    """The median grade from which a text counts as demanding as samples graded ``least`` or more.

    It is the threshold with the fewest errors among at most ``SAMPLES`` samples; of a gap between the two kinds, its
    middle. Infinite without demanding samples, minus infinite without others.
    """
    rows = samples.select(F.col(grade).alias("label"), F.col(text).alias("text")).where("label is not null").orderBy(F.xxhash64("text"), "text").limit(SAMPLES)
    points = sorted((r["grade"], r["label"] >= least) for r in reading_levels(rows, "label").select("grade", "label").dropna().collect())
    hard = sum(h for _, h in points)
    if not hard or hard == len(points):
        return math.inf if not hard else -math.inf
    errors, best, at = len(points) - hard, len(points) + 1, -math.inf  # all above the threshold
    for i, (value, is_hard) in enumerate(points):
        if errors < best and i:
            best, at = errors, (points[i - 1][0] + value) / 2
        errors += 1 if is_hard else -1
    return at


def demanding(levels: DataFrame, threshold: float, least_words: int = 40) -> DataFrame:
    """English texts of ``least_words`` or more whose grade reaches the threshold."""
    return levels.where((F.col("language") == "en") & (F.col("n_words") >= least_words) & (F.col("grade") >= F.lit(threshold)))
