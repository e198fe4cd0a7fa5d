"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence are joined by Bayes' rule, as log probabilities:
  the text, by hashed character trigrams whose counts for each language come from
  labelled documents (multinomial, tempered as neighbouring trigrams overlap);
  the language that the markup declares, by how often pages of a language declare it;
  the address suffix, likewise;
  the host, as the prior: the language shares of its other pages, smoothed towards those of its
  domain, which are smoothed towards those of all pages.
All shares and rates are grouped sums of the text posteriors, so no page's
declaration is believed beyond how well such declarations agree with texts.

Scale: one pass over the documents counts trigrams (combined in each task), one
pass over the pages scores them; sums by host, domain, declaration and suffix
are combined map-side, and a page meets its host's row in a join whose large side AQE splits.
The broadcast table has languages x 2 ** ``hash_bits`` entries; more than ``max_languages``
languages raise an error, so its size has a proven bound.

Nulls and ties: a null html has no text and no declaration; a null url has the empty host
and suffix; a null language or text of a document teaches nothing; repeated rows count as often as they
occur; of equally likely languages the first in alphabetical order is taken; without any language the
result is null.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import prepare
from marketml.session import materialize

HASH_BITS = 15
MAX_LANGUAGES = 512
TEMPER = 1 / 3
STRENGTH = 5.0
_NO_TEXT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
_DECLARED = re.compile(r"""<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])""", re.I)
_META = re.compile(r"""<meta\b[^>]*?http-equiv\s*=\s*["']?content-language["']?[^>]*?content\s*=\s*["']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])""", re.I)
_SPACE = re.compile(r"[\W\d_]+")


def trigram_slots(text: str, bits: int) -> np.ndarray:
    """Hash slots of the character trigrams of the text's words."""
    line = " " + " ".join(_SPACE.split(text.lower())).strip() + " "
    at = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(at) < 3:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        code = ((at[:-2] << np.uint64(42)) ^ (at[1:-1] << np.uint64(21)) ^ at[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - bits)).astype(np.int64)


def visible(source: str) -> str:
    return entities.unescape(_NO_TEXT.sub(" ", source))


def declared(source: str) -> str | None:
    head = _NO_COMMENT.sub("", source) if "<!--" in source else source
    found = _DECLARED.search(head) or _META.search(head)
    return found[1].lower() if found else None


_NO_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)


class TextModel:
    """Log probabilities of trigram slots, a row for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, bits: int):
        self.languages, self.bits = languages, bits
        smooth = counts + 0.1
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T) if languages else np.zeros((1 << bits, 0), np.float32)

    def log_likelihood(self, text: str) -> np.ndarray:
        slots, n = np.unique(trigram_slots(text, self.bits), return_counts=True)
        return TEMPER * (n @ self.table[slots].astype(np.float64))


def train_text_model(docs: DataFrame, hash_bits: int = HASH_BITS, max_languages: int = MAX_LANGUAGES, text: str = "text", lang: str = "lang") -> TextModel:
    """Trigram counts of every document with a language."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.lower(lang).alias("lang"), F.col(text).alias("text"))
    # Before any task holds counts of them: a column that is no language ends here.
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if the model may grow")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name not in counts:
                    counts[name] = np.zeros(1 << hash_bits, np.int64)
                slots, n = np.unique(trigram_slots(t, hash_bits), return_counts=True)
                counts[name][slots] += n
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "slot", "n"])

    counted = materialize(rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "lang-counts")
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())  # those with any trigram
    table = np.zeros((len(languages), 1 << hash_bits))
    index = {name: i for i, name in enumerate(languages)}
    for b in counted.toArrow().to_batches():
        table[[index[x] for x in b.column(0).to_pylist()], b.column(1).to_numpy()] = b.column(2).to_numpy()
    return TextModel(languages, table, hash_bits)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def identify(pages: DataFrame, docs: DataFrame, hash_bits: int = HASH_BITS, max_languages: int = MAX_LANGUAGES, strength: float = STRENGTH, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, confidence) for every page;
    ``docs`` (text, lang) teaches the text model."""
    spark = pages.sparkSession
    prepare(spark)
    model = train_text_model(docs, hash_bits, max_languages)
    shared, size = spark.sparkContext.broadcast(model), len(model.languages)

    @F.arrow_udf(T.StructType([T.StructField("declared", T.StringType()), T.StructField("like", T.ArrayType(T.DoubleType()))]))
    def evidence(sources: pa.Array) -> pa.Array:
        texts = [s or "" for s in sources.to_pylist()]
        like = [np.round(shared.value.log_likelihood(visible(s)), 6).tolist() for s in texts]
        return pa.StructArray.from_arrays([pa.array([declared(s) for s in texts], pa.string()), pa.array(like, pa.list_(pa.float64()))], ["declared", "like"])

    rows = pages.select(F.col(page_id).alias("page_id"), _host(F.col(url)).alias("host"), evidence(F.col(html)).alias("e")).select("page_id", "host", "e.declared", "e.like")
    if not size:
        return rows.select("page_id", "host", "declared", _suffix("host").alias("suffix"), *[F.lit(None).cast(t).alias(n) for n, t in (("text_lang", "string"), ("lang", "string"), ("confidence", "double"))])
    over = lambda f: F.array(*[f(i) for i in range(size)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    soft = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    share = F.transform("w", lambda x: x / total(F.col("w")))
    labels = F.split("host", r"\.")
    # Two labels make a domain, three below a country's short second level (co.uk).
    second = F.when(F.size(labels) > 2, F.element_at(labels, -2))
    wide = (F.length(_suffix("host")) == 2) & (F.length(second) <= 3)
    domain = F.when(F.size(labels) < 3, F.col("host")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))
    domain = F.when(wide & (F.size(labels) > 2), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")).otherwise(domain)
    scored = rows.withColumn("w", soft(F.col("like"))).withColumn("q", share).select("page_id", "host", domain.alias("domain"), _suffix("host").alias("suffix"), F.coalesce("declared", F.lit("")).alias("declared"), "like", "q")
    scored = materialize(scored, "lang-pages")
    sums = [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(size)]
    pack = lambda name: over(lambda i: F.col(f"s{i}")).alias(name)
    host = scored.groupBy("host", "domain").agg(F.count("*").alias("n_host"), *sums)
    dom = host.groupBy("domain").agg(F.sum("n_host").alias("n_dom"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]).select("domain", "n_dom", pack("s_dom"))
    all_ = dom.agg(F.sum("n_dom").alias("n_all"), *[F.sum(F.col("s_dom")[i]).alias(f"s{i}") for i in range(size)]).select("n_all", pack("s_all")).first()
    if all_["n_all"] is None:
        all_ = {"n_all": 0, "s_all": [0.0] * size}
    world = F.array(*[F.lit((s + 1) / (all_["n_all"] + size)) for s in all_["s_all"]])
    priors = host.select(F.col("host").alias("h"), "domain", "n_host", pack("s_host")).join(dom, "domain").select("h", "n_host", "s_host", "n_dom", "s_dom")
    priors = materialize(priors, "lang-hosts")

    def rates(column: str, name: str) -> DataFrame:
        """P(value | language), smoothed towards the value's share of all pages."""
        seen = scored.groupBy(column).agg(F.count("*").alias("n"), *sums)
        rate = over(lambda i: (F.col(f"s{i}") + strength * F.col("n") / max(1, all_["n_all"])) / (float(all_["s_all"][i]) + strength))
        # Written first, so that the join knows its bytes and pages are not shuffled by a few values.
        return materialize(seen.select(F.col(column).alias(f"{name}_key"), rate.alias(name)), f"lang-{column}")

    joined = scored.join(priors, F.col("host") == F.col("h")).join(rates("declared", "by_declared"), F.col("declared") == F.col("by_declared_key")).join(rates("suffix", "by_suffix"), F.col("suffix") == F.col("by_suffix_key"))
    # A page's own posterior is left out of its prior.
    at = lambda name, i: F.col(name)[i]
    rest = lambda s, i: F.greatest(F.lit(0.0), at(s, i) - at("q", i))
    in_domain = lambda i: (rest("s_dom", i) + strength * world[i]) / (F.col("n_dom") - 1 + strength)
    prior = lambda i: (rest("s_host", i) + strength * in_domain(i)) / (F.col("n_host") - 1 + strength)
    log = over(lambda i: F.round(F.log(prior(i)) + F.log(at("by_declared", i)) + F.log(at("by_suffix", i)) + at("like", i), 6))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return joined.withColumn("log", log).select(
        "page_id", "host", F.when(F.col("declared") != "", F.col("declared")).alias("declared"), "suffix", best(F.col("like")).alias("text_lang"), best(F.col("log")).alias("lang"),
        F.round(1 / total(soft(F.col("log"))), 6).alias("confidence"))


def _suffix(host: str):
    """The last label of a host name; a number (an address) has none."""
    last = F.element_at(F.split(host, r"\."), -1)
    return F.when(last.rlike("^[0-9]*$"), F.lit("")).otherwise(last)
