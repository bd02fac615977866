"""Languages of documents and of lines in another language (problem 6).

The method is Bayesian evidence fusion. A word model fitted on a bounded sample of labelled texts gives
every line its log likelihoods (one matrix gather for a whole batch). Three sources of evidence on a document's language are
added as log odds:

* its text: each line speaks for its language with its margin, the nats by which the likelihood of its best language
  is ahead; the document's nats are shared among the languages by their characters, so that long texts
  decide for themselves and a few words hardly do;
* its declared label: how often labels are right, counted over the documents whose text decides alone, by group;
* priors of its group: counts of such documents by language.

Both counts are smoothed hierarchically (extension in file type, then file type, then all). The line
decision falls back on its element where the line alone says too little; a line whose element says too little as
well is taken for its document's language.

Damaged lines are restored first (problem 3) and look-alike letters folded (problem 5), so a wrongly
decoded line keeps the language it was written in.

Defined results: documents without a word get no language and no row; null text counts as none; a document
whose label is missing, null, unreadable or names no language has label null; repeated deliveries count once
in the results; a null doc_id or elem_no gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from paperloom.llm.encoding import repair_text
from paperloom.llm.lookalike import canonical_text
from paperloom.runtime import cut, small

LANGS = ("en", "de", "fr", "es", "pt", "ar", "ru")
#: Names of the languages in labels, without region (fixed values).
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish español",
    "pt": "pt por portuguese português", "ar": "ar ara arabic العربية", "ru": "ru rus russian русский",
}
#: Function words that stand in for a language of which the sample has little (fixed values).
SEEDS = {
    "en": "the of and to in is for that on with as by this from not be are it or an",
    "de": "der die das und in zu den mit von für ist auf dem nicht ein eine im des bei nach",
    "fr": "le la les de des et un une du en dans est pour que sur par avec ne pas au",
    "es": "el la los las de del y en un una que por con para es no se al según hasta",
    "pt": "o a os as de do da e em um uma que por com para não se ao na no",
    "ar": "في من على إلى أن عن مع هذا بعد قبل كل لا ما التي عند تحت ضمن حتى بجانب منذ",
    "ru": "и в на не по с из для от до за о к что при но после без под это",
}
PROSE = ("heading", "paragraph", "list", "note", "table", "cell")
#: Bound of the labelled sample the model is fitted on: documents of each language, and characters of each of them.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 20_000
LEAST_WORDS = 5
#: Log odds under which a line is left to its element; a sentence of five known words has far more.
LEAST_MARGIN = 8.0
#: Nats by which a document's text decides alone, and is counted for labels and priors.
DECIDED = 12.0
#: Pseudo-documents that a group takes over from the wider one.
PSEUDO = 20.0

_WORDS = re.compile(r"[^\W\d_]+")


# --- word model --------------------------------------------------------------------------------------


def labelled_sample(documents: DataFrame, per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang and text of at most `per_language` documents of each language, the first by a hash of their id, `chars` of each.

    Only ids and hashes are ranked; the texts of the chosen ids, at most 7 * per_language, are fetched by a
    broadcast of that bounded list. What is collected of it has at most 7 * per_language * chars characters.
    """
    ids = documents.where(F.col("lang").isin(*LANGS) & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = ids.withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id", "lang")
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", F.substring("text", 1, chars).alias("text"))


def fit(rows: list[tuple[str, str]], alpha: float = 0.5) -> dict[str, np.ndarray]:
    """word -> log likelihoods over LANGS, centred, so that an unknown word says nothing."""
    counts = {x: Counter({w: 5 for w in SEEDS[x].split()}) for x in LANGS}
    for lang, text in rows:
        counts[lang].update(_WORDS.findall(text.lower()))
    vocabulary = set().union(*counts.values())
    total = np.array([sum(counts[x].values()) for x in LANGS], dtype=float)
    model = {}
    for w in vocabulary:
        c = np.array([counts[x][w] for x in LANGS], dtype=float)
        if c.sum() < 3:
            continue
        p = (c + alpha * total / total.sum()) / (total + alpha * len(vocabulary))
        v = np.log(p)
        model[w] = np.clip(v - v.mean(), -4, 4).astype(np.float32)
    return model


_AR, _RU = LANGS.index("ar"), LANGS.index("ru")
#: Letters that speak for a language in a word the sample lacks (fixed values).
_MARKS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "ã": "pt", "õ": "pt", "è": "fr", "ê": "fr", "ù": "fr", "œ": "fr", "î": "fr"}


def _unknown(word: str) -> np.ndarray:
    v = np.zeros(len(LANGS), dtype=np.float32)
    c = word[0]
    if "Ѐ" <= c < "԰":
        v[_RU] = 3
    elif "؀" <= c < "܀":
        v[_AR] = 3
    else:
        for m in word:
            if m in _MARKS:
                v[LANGS.index(_MARKS[m])] = 1.0
                break
    return v


class Scorer:
    """Line scores of a batch of texts."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.index = {w: i for i, w in enumerate(model)}
        self.rows = list(model.values())
        self.matrix = np.array(self.rows, dtype=np.float32).reshape(-1, len(LANGS))
        self.known = len(self.rows)

    def lookup(self, words: list[str]) -> list[int]:
        get = self.index.get
        ids = list(map(get, words))
        if None in ids:
            for k, i in enumerate(ids):
                if i is None:
                    w = words[k]
                    i = self.index.get(w)
                    if i is None:
                        i = len(self.rows)
                        self.index[w] = i
                        self.rows.append(_unknown(w))
                    ids[k] = i
        return ids

    def forget(self, most: int = 500_000) -> None:
        """Starts the memory of unknown words anew when there are too many; only between batches, whose ids point at it."""
        if len(self.rows) > self.known + most:
            self.index = {x: n for x, n in self.index.items() if n < self.known}
            del self.rows[self.known :]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, line number, words, characters, scores) of every line with a word."""
        self.forget()
        ids: list[int] = []
        of, line_no, n_words, n_chars = [], [], [], []
        for t, text in enumerate(texts):
            if not text.isascii():
                text, damaged, _ = repair_text(text)
                text = canonical_text(text)
            for k, line in enumerate(text.lower().split("\n"), 1):
                words = _WORDS.findall(line)
                if words:
                    ids += self.lookup(words)
                    of.append(t)
                    line_no.append(k)
                    n_words.append(len(words))
                    n_chars.append(len(line))
        if not of:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, empty, empty, np.zeros((0, len(LANGS)), dtype=np.float32)
        if len(self.rows) != len(self.matrix):
            self.matrix = np.array(self.rows, dtype=np.float32)
        words_at = np.array(n_words)
        starts = np.concatenate([[0], np.cumsum(words_at)[:-1]])
        return np.array(of), np.array(line_no), words_at, np.array(n_chars), np.add.reduceat(self.matrix[np.array(ids)], starts, axis=0)


_SEGMENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()), T.StructField("elem_no", T.LongType()), T.StructField("lang", T.StringType()),
        T.StructField("chars", T.LongType()), T.StructField("nats", T.DoubleType()),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("confidence", T.FloatType())]))),
    ]
)


_LINES = pa.list_(pa.struct([("line_no", pa.int32()), ("confidence", pa.float32())]))


def segments(elements: DataFrame, model: dict[str, np.ndarray], least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each element and language in it: characters, nats of its lines' margins, and its lines of enough words with their confidence."""
    shared = elements.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            doc, elem, text = (b.column(i).to_pylist() for i in range(3))
            of, line, words, chars, scores = scorer.score(text)
            out: list[list] = [[], [], [], [], [], []]
            if len(of):
                whole = np.zeros((len(text), len(LANGS)), dtype=np.float32)
                np.add.at(whole, of, scores)
                top2 = np.partition(scores, -2, axis=1)[:, -2:]
                two = np.partition(whole, -2, axis=1)[:, -2:]
                weak = top2[:, 1] - top2[:, 0] < LEAST_MARGIN
                best = np.where(weak, whole[of].argmax(axis=1), scores.argmax(axis=1))
                told = ~weak | (two[of, 1] - two[of, 0] >= LEAST_MARGIN)
                # a weak line is judged by its element's words
                judged = np.where(weak[:, None], whole[of], scores)
                soft = np.exp(np.minimum(judged - judged[np.arange(len(of)), best][:, None], 50))
                conf = 1.0 / soft.sum(axis=1)
                key = of * len(LANGS) + best
                keys, inverse = np.unique(key, return_inverse=True)
                total, nats = np.bincount(inverse, chars), np.bincount(inverse, top2[:, 1] - top2[:, 0])
                lines: list[list[dict]] = [[] for _ in keys]
                for i in np.flatnonzero((words >= least_words) & told):
                    lines[inverse[i]].append({"line_no": int(line[i]), "confidence": float(conf[i])})
                for i, k in enumerate(keys):
                    t = k // len(LANGS)
                    for column, x in zip(out, (doc[t], elem[t], LANGS[k % len(LANGS)], int(total[i]), float(nats[i]), lines[i]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.float64()), pa.array(out[5], _LINES)],
                names=_SEGMENTS.names,
            )

    prose = elements.where(F.col("element_type").isin(*PROSE) & F.col("text").rlike(r"\S") & F.col("doc_id").isNotNull() & F.col("elem_no").isNotNull())
    return prose.select("doc_id", "elem_no", "text").mapInArrow(run, _SEGMENTS)


# --- declared labels ---------------------------------------------------------------------------------


def declared(properties: Column) -> Column:
    """The language named by a document's properties, null where there is none."""
    doc = F.try_parse_json(properties)
    paths = [f"$.{k}.core_properties.language" for k in ("word", "workbook", "powerpoint")] + ["$.pdf.metadata['/Lang']"]
    label = F.coalesce(*(F.try_variant_get(doc, p, "string") for p in paths))
    name = F.lower(F.regexp_extract(F.trim(label), r"^([^\s_-]*)", 1))
    known = {n: lang for lang, names in NAMES.items() for n in names.split()}
    out = F.lit(None).cast("string")
    for lang in LANGS:
        out = F.when(name.isin(*[n for n, x in known.items() if x == lang]), F.lit(lang)).otherwise(out)
    return out


def labels(docs: DataFrame) -> DataFrame:
    """doc_id, label and the group keys of its priors, once per document."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", declared(F.col("properties")).alias("label"), "document_type", "extension").dropDuplicates(["doc_id"])


# --- fusion ------------------------------------------------------------------------------------------


def _smoothed(df: DataFrame, keys: list[str], hits: str, all_n: str, start: Column, pseudo: float, out: str) -> DataFrame:
    """`df` (one row per finest group and `keys`) with the share of `hits` in `all_n`, each level smoothed by the wider one."""
    share = start
    for level in ([], ["document_type"], ["document_type", "extension"]):
        part = W.partitionBy(*level, *keys)
        share = (F.sum(hits).over(part) + pseudo * share) / (F.sum(all_n).over(part) + pseudo)
    return df.withColumn(out, share)


def fuse(found: DataFrame, docs: DataFrame, decided: float = DECIDED, pseudo: float = PSEUDO) -> DataFrame:
    """doc_id, label, lang and confidence: text evidence, declared label and smoothed group priors together.

    Tables of groups have a row for each file type, extension and language.
    """
    n_langs = len(LANGS)
    each = F.array(*(F.struct(F.lit(x).alias("lang"), F.sum(F.when(F.col("lang") == x, F.col("chars")).otherwise(0)).alias("chars")) for x in LANGS))
    per = found.groupBy("doc_id").agg(each.alias("by"), F.sum("chars").alias("total"), F.sum("nats").alias("nats"))
    text = F.transform("by", lambda x: F.struct(x["lang"].alias("lang"), (F.col("nats") * x["chars"] / F.col("total")).alias("nats")))
    per = cut(per.select("doc_id", text.alias("text")).join(labels(docs), "doc_id", "left"))
    sorted_nats = F.sort_array(F.transform("text", lambda x: x["nats"]), asc=False)
    own = F.array_max(F.transform("text", lambda x: F.struct(x["nats"], x["lang"])))["lang"]
    sure = per.where(sorted_nats[0] - sorted_nats[1] >= decided).select("document_type", "extension", "label", own.alias("lang"))
    group = ["document_type", "extension"]
    counted = sure.groupBy(*group, "lang").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == F.col("lang")).alias("right"))
    groups = per.select(*group).distinct().withColumn("lang", F.explode(F.array(*map(F.lit, LANGS))))
    g, c = groups.alias("g"), counted.alias("c")
    same = F.col("g.document_type").eqNullSafe(F.col("c.document_type")) & F.col("g.extension").eqNullSafe(F.col("c.extension")) & (F.col("g.lang") == F.col("c.lang"))
    table = g.join(c, same, "left").select("g.*", *(F.coalesce(f"c.{x}", F.lit(0)).alias(x) for x in ("n", "labelled", "right")))
    table = table.withColumn("of_group", F.sum("n").over(W.partitionBy(*group)))
    table = _smoothed(table, ["lang"], "n", "of_group", F.lit(1.0 / n_langs), pseudo, "prior")
    table = _smoothed(table, [], "right", "labelled", F.lit(0.75), pseudo, "right_share")
    odds = F.log(F.col("right_share") * (n_langs - 1) / (1 - F.col("right_share")))
    prior = table.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("lang", F.log("prior")))).alias("prior"), F.max(odds).alias("label_odds"))
    p, q = per.alias("p"), prior.alias("q")
    same = F.col("p.document_type").eqNullSafe(F.col("q.document_type")) & F.col("p.extension").eqNullSafe(F.col("q.extension"))
    joined = p.join(small(prior).alias("q"), same).select("doc_id", "label", "text", "q.prior", "label_odds")
    score = F.transform("text", lambda x: F.struct((x["nats"] + F.element_at("prior", x["lang"]) + F.when(F.col("label") == x["lang"], F.col("label_odds")).otherwise(0.0)).alias("score"), x["lang"].alias("lang")))
    best = joined.withColumn("scores", score).withColumn("top", F.array_max("scores"))
    return best.select("doc_id", "label", F.col("top.lang").alias("lang"), (1 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x["score"] - F.col("top.score")))).alias("confidence"))


def detect(docs: DataFrame, elements: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with label, language and confidence; lines in another language than their document's, each with its own)."""
    model = fit([(r.lang, r.text) for r in labelled_sample(documents).collect()])
    found = cut(segments(elements, model))
    per_doc = cut(fuse(found, docs))
    foreign = found.join(per_doc.select("doc_id", F.col("lang").alias("main")), "doc_id").where("lang <> main")
    lines = foreign.select("doc_id", "elem_no", F.explode("lines").alias("x"), "lang").select("doc_id", "elem_no", "x.line_no", "lang", "x.confidence")
    return per_doc, lines.dropDuplicates(["elem_no", "line_no"])


def languages(docs: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, elem_no, line_no, lang and confidence: a row (0, 0) for each document, and one for each line in another language."""
    per_doc, lines = detect(docs, elements, documents)
    whole = per_doc.select("doc_id", F.lit(0).cast("long").alias("elem_no"), F.lit(0).alias("line_no"), "lang", F.col("confidence").cast("double").alias("confidence"))
    return whole.unionByName(lines.withColumn("confidence", F.col("confidence").cast("double")))


def language_found(docs: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    per_doc, lines = detect(docs, elements, documents)
    wrong = per_doc.where("label is null or label <> lang").select("doc_id", F.lit(0).cast("long").alias("elem_no"), F.lit(0).alias("line_no"), "lang")
    return wrong.unionByName(lines.select("doc_id", "elem_no", "line_no", "lang"))
