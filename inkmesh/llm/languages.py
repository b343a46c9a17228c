"""Missing or wrong document language labels (problem 8): multilingual mixture inference.

A document is a mixture of languages, a cue is in one of them. Every word has a likelihood in
each language from an interpolated character n-gram model; expectation-maximisation estimates
the document's proportions from the cues' likelihoods, and the set of languages is chosen by
penalised likelihood: a language stays only if the likelihood drops by more than PENALTY
without it. Cues then take their most probable language, which gives counts of words, segments
and confidences.

The n-gram model is fitted on a bounded sample: about SAMPLE documents for each language, taken
by a hash of their id among those whose label names it and whose text is not empty, and of each
the SAMPLE_CUES cues of least hash from its whole length (pieces of at most CUE_CHARS characters,
where a cue is longer). As labels err, the sample's cues are re-labelled by the model itself
ROUNDS times. Cues that are UTF-8 read in a code page of one byte are repaired first, as their words
would count several times. The same sample shows what adverts and credits look like: short cues that recur
under unrelated titles, each time with another name. All documents are then read whole, in one pass without a shuffle.
"""

from __future__ import annotations

import codecs
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.subtitles import WORD, cues

ORDER, SAMPLE, SAMPLE_CUES, CUE_CHARS, ROUNDS = 4, 250, 300, 1000, 2
PENALTY, SHARE = 8.0, 0.2
_ALPHABET = 300.0
_CACHE = 200_000

# Names of the languages in codes of two and three letters and in English.
NAMES = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish"),
    "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
    "sv": ("swe", "swedish"),
}
#: An advert's sure sign is a web address.
ADDRESS = re.compile(r"\bwww\.|\bhttps?:|\b[\w-]+\.(?:com|net|org|info|example)\b", re.IGNORECASE)
#: Adverts are cues of AD_WORDS words, the same under AD_TITLES titles or more but for a name of up to AD_NAME words.
AD_WORDS, AD_TITLES, AD_NAME, AD_MARK = (3, 10), 4, 2, 0.5
#: Counters of templates met, by hash: all that is held of those that do not recur.
AD_COUNTERS = 1 << 22
LANGUAGES = sorted(NAMES)
_BY_NAME = {n: code for code, names in NAMES.items() for n in (code, *names)}


def label_code(label: Column) -> Column:
    """Two-letter code of what a label names among LANGUAGES; null for anything else."""
    head = F.regexp_replace(F.lower(F.trim(label)), r"[-_][a-z0-9]+([-_][a-z0-9]+)*$", "")
    table = F.create_map(*(F.lit(x) for pair in _BY_NAME.items() for x in pair))
    return F.try_element_at(table, head)


Template = tuple[tuple[str, ...], tuple[str, ...]]


def _templates(w: list[str]) -> Iterator[Template]:
    """(words before, words behind) a run of up to AD_NAME words of a cue; at least two words stay."""
    for name in range(1, min(AD_NAME, len(w) - 2) + 1):
        for i in range(len(w) - name + 1):
            yield tuple(w[:i]), tuple(w[i + name :])


@dataclass
class Adverts:
    """What tells adverts and credits from speech: web addresses, and learned templates around a name.

    A template is kept when one of its words is a mark: a word that stands in such templates at
    least as often as elsewhere. Cues that lack a mark are never compared with templates.
    """

    templates: frozenset[Template] = frozenset()
    marks: frozenset[str] = frozenset()

    def has(self, cue: str, w: list[str]) -> bool:
        if "." in cue or ":" in cue:
            if ADDRESS.search(cue):
                return True
        if self.marks.isdisjoint(w) or not AD_WORDS[0] <= len(w) <= AD_WORDS[1]:
            return False
        return any(t in self.templates for t in _templates(w))


def learn_adverts(sample: list[tuple[int, list[list[str]]]]) -> Adverts:
    """From (title, words of its cues): the templates that recur under unrelated titles with other names."""
    short = [(title, w) for title, own in sample for w in own if AD_WORDS[0] <= len(w) <= AD_WORDS[1]]
    met = np.zeros(AD_COUNTERS, dtype=np.int32)
    for k in range(0, len(short), 1000):
        at = [hash(t) % AD_COUNTERS for _, w in short[k : k + 1000] for t in _templates(w)]
        np.add.at(met, np.array(at, dtype=np.int64), 1)
    seen: dict[Template, tuple[set, set]] = {}
    for title, w in short:
        for t in _templates(w):
            if met[hash(t) % AD_COUNTERS] >= AD_TITLES:
                titles, names = seen.setdefault(t, (set(), set()))
                titles.add(title)
                names.add(tuple(w[len(t[0]) : len(w) - len(t[1])]))
    often = {t for t, (titles, names) in seen.items() if min(len(titles), len(names)) >= AD_TITLES}
    in_all, in_templates = Counter(), Counter()
    for _, w in short:
        in_all.update(set(w))
        in_templates.update({x for t in _templates(w) if t in often for side in t for x in side})
    marks = {x for x, n in in_templates.items() if n >= AD_MARK * in_all[x]}
    kept = {t for t in often if any(x in marks for side in t for x in side)}
    return Adverts(frozenset(kept), frozenset(x for t in kept for side in t for x in side if x in marks))


@dataclass
class Model:
    """Log-likelihoods of the last character of n-grams, per language, and what tells adverts."""

    grams: dict[str, np.ndarray]
    floor: np.ndarray
    adverts: Adverts = field(default_factory=Adverts)

    def word(self, w: str) -> np.ndarray:
        s, total = f"\x02{w}\x03", np.zeros(len(LANGUAGES))
        for i in range(1, len(s)):
            for lo in range(max(0, i - ORDER + 1), i + 1):
                v = self.grams.get(s[lo : i + 1])
                if v is not None:
                    total = total + v
                    break
            else:
                total = total + self.floor
        return total


def fit_model(counts: list[Counter]) -> Model:
    """From the word counts of each language: interpolated n-grams of up to ORDER characters."""
    k = len(counts)
    raw: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER + 1)]
    context: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER + 1)]
    for lang, words in enumerate(counts):
        for w, c in words.items():
            s = f"\x02{w}\x03"
            for i in range(1, len(s)):
                for n in range(1, ORDER + 1):
                    if i - n + 1 < 0:
                        break
                    g = s[i - n + 1 : i + 1]
                    raw[n].setdefault(g, np.zeros(k))[lang] += c
                    context[n].setdefault(g[:-1], np.zeros(k))[lang] += c
    probs: dict[str, np.ndarray] = {}
    base = np.full(k, 1 / _ALPHABET)
    for n in range(1, ORDER + 1):
        weight = 4.0
        for g, c in raw[n].items():
            lower = probs.get(g[1:], base) if n > 1 else base
            probs[g] = (c + weight * lower) / (context[n][g[:-1]] + weight)
    return Model({g: np.log(p) for g, p in probs.items()}, np.log(base))


def mixture(scores: np.ndarray, sizes: np.ndarray, langs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over the given languages: (log-likelihood, proportions, responsibilities)."""
    part = scores[:, langs]
    top = part.max(axis=1, keepdims=True)
    like = np.exp(part - top)
    share = np.full(len(langs), 1 / len(langs))
    for _ in range(40):
        joint = like * share
        total = joint.sum(axis=1, keepdims=True)
        resp = joint / total
        new = np.maximum((resp * sizes[:, None]).sum(axis=0) / sizes.sum(), 1e-9)
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    joint = like * share
    total = joint.sum(axis=1, keepdims=True)
    return float(np.log(total).sum() + top.sum()), share, joint / total


def infer(scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, confidence) of each cue from its log-likelihoods and numbers of words."""
    langs = np.unique(scores.argmax(axis=1))
    best, share, resp = mixture(scores, sizes, langs)
    while len(langs) > 1:
        # Only the least of the languages can be the next to go.
        keep = np.delete(np.arange(len(langs)), int(share.argmin()))
        less = mixture(scores, sizes, langs[keep])
        if best - less[0] >= PENALTY:
            break
        langs, (best, share, resp) = langs[keep], less
    if len(langs) == 1:  # how surely it is none of the others
        part = scores - scores.max(axis=1, keepdims=True)
        p = np.exp(part)
        return np.full(len(scores), langs[0]), p[:, langs[0]] / p.sum(axis=1)
    at = resp.argmax(axis=1)
    return langs[at], resp[np.arange(len(at)), at]


class Reader:
    """Cues of texts with their word likelihoods; the words' vectors are kept."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows, self.table = model, {}, np.zeros((1024, len(LANGUAGES)))

    def row(self, w: str) -> int:
        k = self.rows.get(w)
        if k is None:
            if len(self.rows) >= _CACHE:
                self.rows.clear()
            k = self.rows[w] = len(self.rows)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = self.model.word(w)
        return k

    def read(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(places of cues, scores, numbers of words); adverts and cues without words are left out."""
        at, sizes, own = [], [], []
        rows = self.rows
        for k, cue in enumerate(cues(text)):
            cue = repaired(cue)
            w = WORD.findall(cue.lower())
            if w and not self.model.adverts.has(cue, w):
                at.append(k)
                sizes.append(len(w))
                own.append(w)
        if not at:
            return at, np.zeros((0, len(LANGUAGES))), np.zeros(0)
        flat = [x for w in own for x in w]
        if len(rows) + len(flat) >= _CACHE:
            rows.clear()
        idx = [r if (r := rows.get(x)) is not None else self.row(x) for x in flat]
        starts = np.cumsum([0, *sizes[:-1]])
        return at, np.add.reduceat(self.table[idx], starts, axis=0), np.array(sizes)


def _raw_byte(e: UnicodeError) -> tuple[bytes, int]:
    """Bytes that a code page leaves out stand for themselves."""
    if isinstance(e, UnicodeEncodeError) and all(0x80 <= ord(c) < 0xA0 for c in e.object[e.start : e.end]):
        return bytes(map(ord, e.object[e.start : e.end])), e.end
    raise e


codecs.register_error("inkmesh.raw_byte", _raw_byte)


def repaired(cue: str) -> str:
    """A cue with those lines decoded anew that are UTF-8 read in a code page of one byte.

    Such lines hold two or three characters for a letter, punctuation among them, so their words
    would count several times. Text in any language is no valid UTF-8 in these code pages. A
    replacement character can only be the one byte that the Cyrillic page lacks.
    """
    if cue.isascii():
        return cue
    lines = cue.split("\n")
    for k, s in enumerate(lines):
        if s.isascii():
            continue
        for page, lost in (("cp1252", "\ufffd"), ("cp1251", "\x98")):
            try:
                lines[k] = s.replace("\ufffd", lost).encode(page, "inkmesh.raw_byte").decode("utf-8")
                break
            except UnicodeError:
                continue
    return "\n".join(lines)


def drawn_cues(text: str, most: int = SAMPLE_CUES) -> list[str]:
    """At most ``most`` cues of a text, those of least hash, in order."""
    pieces = []
    for c in map(repaired, cues(text)):
        pieces += [c] if len(c) <= CUE_CHARS else re.findall(rf"\S.{{0,{CUE_CHARS - 1}}}(?!\S)|\S{{1,{CUE_CHARS}}}", c, re.DOTALL)
    if len(pieces) <= most:
        return pieces
    least = heapq.nsmallest(most, range(len(pieces)), key=lambda k: (zlib.crc32(pieces[k].encode("utf-8", "surrogatepass"), k), k))
    return [pieces[k] for k in sorted(least)]


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = pa.array([drawn_cues(t) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("title"), own], names=["code", "title", "cues"])


def train(labelled: list[tuple[str, int, list[str]]]) -> Model:
    """Model from (code, title, cues), re-labelled cue by cue."""
    split = [(code, title, [(c, WORD.findall(c.lower())) for c in own]) for code, title, own in labelled]
    adverts = learn_adverts([(title, [w for _, w in own]) for _, title, own in split])
    texts = [(LANGUAGES.index(code), [w for c, w in own if w and not adverts.has(c, w)]) for code, _, own in split]
    counts = [Counter() for _ in LANGUAGES]
    for lang, own in texts:
        for w in own:
            counts[lang].update(w)
    model = fit_model(counts)
    for _ in range(ROUNDS):
        cache: dict[str, np.ndarray] = {}
        counts = [Counter() for _ in LANGUAGES]
        for _, own in texts:
            if not own:
                continue
            vec = lambda x: cache[x] if x in cache else cache.setdefault(x, model.word(x))
            scores = np.array([sum(vec(x) for x in w) for w in own])
            langs, sure = infer(scores, np.array([len(w) for w in own]))
            for w, lang, p in zip(own, langs.tolist(), sure.tolist(), strict=True):
                if p > 0.9:
                    counts[lang].update(w)
        model = fit_model(counts)
    model.adverts = adverts
    return model


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from a bounded sample of labelled documents; None where no label names a language.

    Documents of one ``title_id`` are related; without that column or value each is a title.
    """
    code = label_code(F.col("lang"))
    title = F.negate(F.col("doc_id")) - 1
    title = F.coalesce(F.xxhash64("title_id"), title) if "title_id" in documents.columns else title
    own = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).withColumn("code", code).where("code is not null")
    sizes = {r["code"]: r["n"] for r in own.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    part = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, sample / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = own.where(draw < F.try_element_at(part, F.col("code"))).select("code", title.alias("title"), "text")
    rows = drawn.mapInArrow(_drawn, "code string, title bigint, cues array<string>").limit(2 * sample * len(LANGUAGES)).collect()
    return train(sorted((r["code"], r["title"], r["cues"]) for r in rows))


def _detected(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    reader, blind = Reader(model), not model.grams
    seg = pa.struct([("first_cue", pa.int32()), ("last_cue", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("words", pa.int32()), ("segments", pa.list_(seg))])
    for batch in batches:
        words, segments = [], []
        for text in batch.column("text").to_pylist():
            at, scores, sizes = reader.read("" if blind else text)
            own: list[dict] = []
            if at:
                langs, sure = infer(scores, sizes)
                for k, lang, n, p in zip(at, langs.tolist(), sizes.tolist(), sure.tolist(), strict=True):
                    if own and own[-1]["lang"] == LANGUAGES[lang]:
                        s = own[-1]
                        s["confidence"] = (s["confidence"] * s["words"] + p * n) / (s["words"] + n)
                        s["last_cue"], s["words"] = k, s["words"] + n
                    else:
                        own.append({"first_cue": k, "last_cue": k, "lang": LANGUAGES[lang], "words": n, "confidence": p})
            words.append(int(sizes.sum()))
            segments.append(own)
        arrays = [batch.column("doc_id"), batch.column("lang"), pa.array(words, pa.int32()), pa.array(segments, pa.list_(seg))]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def detect(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, words, segments) of documents (doc_id, lang, text).

    A segment is a stretch of cues in one language. Null ids or texts are left out; texts
    without spoken words have no segments; adverts are not counted. Without a model, as where
    no document at all has a label that names a language, no text has segments.
    """
    model = model or fit(documents) or Model({}, np.zeros(len(LANGUAGES)))
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", F.col("lang").cast("string"), "text")
    schema = (
        "doc_id bigint, lang string, words int, "
        "segments array<struct<first_cue:int, last_cue:int, lang:string, words:int, confidence:double>>"
    )
    return docs.mapInArrow(lambda it: _detected(it, model), schema)


def languages(found: DataFrame) -> DataFrame:
    """(doc_id, label, lang_found, words, share, confidence) of all languages that belong to documents."""

    def total(lang: Column) -> tuple[Column, Column]:
        own = F.filter("segments", lambda s: s["lang"] == lang)
        n = F.aggregate(own, F.lit(0), lambda a, s: a + s["words"])
        c = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["words"] * s["confidence"])
        return n, c / n

    each = found.withColumn("lang_found", F.explode(F.array_distinct(F.transform("segments", lambda s: s["lang"]))))
    n, sure = total(F.col("lang_found"))
    each = each.withColumn("n", n).withColumn("confidence", sure).where(F.col("n") * F.lit(round(1 / SHARE)) >= F.col("words"))
    return each.select(
        "doc_id", F.col("lang").alias("label"), "lang_found", F.col("n").alias("words"), (F.col("n") / F.col("words")).alias("share"), "confidence"
    )


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, lang_found): one row per language of documents whose label is missing, wrong or not all.

    A document delivered twice counts once.
    """
    labelled = found.withColumn("code", label_code(F.col("lang")))
    own = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    belongs = F.filter(
        own,
        lambda x: F.aggregate(F.filter("segments", lambda s: s["lang"] == x), F.lit(0), lambda a, s: a + s["words"]) * F.lit(round(1 / SHARE))
        >= F.col("words"),
    )
    cases = labelled.withColumn("belongs", belongs)
    right = (F.size("belongs") == 1) & (F.get("belongs", F.lit(0)) == F.coalesce("code", F.lit("")))
    return cases.where(~right).select("doc_id", F.explode("belongs").alias("lang_found")).distinct()


def segments(found: DataFrame) -> DataFrame:
    """(doc_id, first_cue, last_cue, lang, words, confidence) of every stretch in one language."""
    return found.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")
