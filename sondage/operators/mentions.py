"""Which labels of a dictionary texts mention, for dictionaries and texts of any size.

A dictionary of up to ``_FEW_LABELS`` goes to all tasks, each of which walks its own texts once: no text is shuffled, and no frequent word gathers texts in a task. Of larger ones a label is looked for only in texts that have its rarest part: a whole word for labels of ASCII words, three characters for others. So that join is an equal one, on keys that few texts have; a label of frequent parts alone is compared with the texts that it is likely to be in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import STOPWORDS, semantic_tokens
from sondage.operators.selection import apart, hold, let

#: How a question asks for a definition.
DEFINITION_MARKERS = ("是什么", "什么意思", "什么含义", "含义", "全称", "解释", "怎么理解", "如何理解", "指什么", "区别", "what is", "what does", "meaning", "define", "explain")


#: A dictionary of so many labels is broadcast; a larger one is joined by a shuffle. Characters that a task walks at once.
_FEW_LABELS, _CHARS = 1 << 16, 1 << 20
#: Multiplier of the hashes of stretches of characters, modulo 2 ** 64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(44)


def bounded(label: Column) -> Column:
    """ASCII words, which other letters and digits may not touch."""
    return label.rlike("^[a-z0-9][a-z0-9 .&/-]*$")


def _grams(text: Column, sizes: list[int]) -> Column:
    """All runs of so many characters: an empty match at each place, with what follows it as its group."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes)))


def expand(keys: np.ndarray, groups: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with each value of its group, where group g has the values from starts[g] to starts[g + 1]."""
    sizes = (starts[1:] - starts[:-1])[groups]
    ends = np.cumsum(sizes)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return np.repeat(keys, sizes), values[np.repeat(starts[groups], sizes) + within]


def dictionary(terms: dict[str, int]) -> dict[int, tuple[np.ndarray, tuple | None]]:
    """For each length up to the longest of the terms (term: number): which leading bits of hashes a term has that is so long or longer; and sorted hashes, characters and numbers of the terms of this length, whose hashes are distinct."""
    sizes: dict[int, list[str]] = {}
    for t in terms:
        sizes.setdefault(len(t), []).append(t)
    codes = {n: np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n) for n, own in sizes.items()}
    hashes = {n: np.zeros(len(own), np.uint64) for n, own in sizes.items()}
    found = {}
    for n in range(1, max(sizes, default=0) + 1):
        flags, own = np.zeros(1 << 20, bool), None
        for m in hashes:
            if m >= n:
                hashes[m] = hashes[m] * _BASE + codes[m][:, n - 1]
                flags[hashes[m] >> _SHIFT] = True
        if n in sizes:
            order = np.argsort(hashes[n])
            if (np.diff(hashes[n][order]) == 0).any():
                raise ValueError(f"two terms of {n} characters have one hash")
            own = hashes[n][order], codes[n][order], np.array([terms[t] for t in sizes[n]], np.int64)[order]
        found[n] = flags, own
    return found


def places(texts: list[str], by_size: dict[int, tuple[np.ndarray, tuple | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of texts, of the terms of a ``dictionary`` that are anywhere in them, and all places, from 0: a place is followed while a term may begin there, and compared where one ends."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at, hashes, none = np.arange(len(codes)), np.zeros(len(codes), np.uint64), np.empty(0, np.int64)
    found = [(none, none, none)]
    for n, (flags, own) in by_size.items():
        on = np.flatnonzero(at + n <= ends[owner[at]])
        at = at[on]
        hashes = hashes[on] * _BASE + codes[at + n - 1]
        on = np.flatnonzero(flags[hashes >> _SHIFT])
        at, hashes = at[on], hashes[on]
        if own is not None:
            keys, chars, numbers = own
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            same = np.flatnonzero(keys[place] == hashes)
            same = same[(codes[at[same][:, None] + np.arange(n)] == chars[place[same]]).all(1)]
            text = owner[at[same]]
            found.append((text, numbers[place[same]], at[same] - (ends - sizes)[text]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _walked(few: pa.Table, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """``mention_join`` of few labels (label_id, label, bounded), each text by itself."""
    names = few.column("label").to_pylist()
    terms = {t: i for i, t in enumerate(dict.fromkeys(names))}
    number = np.array([terms[t] for t in names], np.int64)
    order = np.argsort(number, kind="stable")
    ids, starts = few.column("label_id").combine_chunks().take(pa.array(order)), np.searchsorted(number[order], np.arange(len(terms) + 1))
    whole = np.zeros(len(terms), bool)
    whole[number] = np.asarray(few.column("bounded"), bool)
    shared = texts.sparkSession.sparkContext.broadcast((ids, starts, terms, whole, np.array([len(t) for t in terms], np.int64)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, terms, whole, sizes = shared.value
        by_size = dictionary(terms)
        for batch in batches:
            lengths = np.cumsum([0, *map(len, batch.column("text").to_pylist())])
            start = 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(lengths, lengths[start] + _CHARS, "right")) - 1)
                part = batch.slice(start, stop - start)
                start = stop
                own = part.column("text").to_pylist()
                text, term, at = places(own, by_size)
                # ASCII letters and digits may not touch a bounded label
                word = np.zeros(lengths[stop] - lengths[stop - len(part)] + 1, bool)
                codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
                word[:-1] = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
                begin = lengths[stop - len(part) : stop] - lengths[stop - len(part)]
                end = lengths[stop - len(part) + 1 : stop + 1] - lengths[stop - len(part)]
                first = begin[text] + at
                last = first + sizes[term]
                touched = ((at > 0) & word[first - 1]) | ((last < end[text]) & word[last])
                on = np.flatnonzero(~(whole[term] & touched))
                on = on[np.lexsort((at[on], term[on], text[on]))]
                text, term, at = text[on], term[on], at[on]
                on = np.ones(len(on), bool)
                on[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
                nth, label = expand(np.flatnonzero(on), term[on], np.arange(len(ids)), starts)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(label)), part.column("text_id").take(pa.array(text[nth])), pa.array(at[nth], pa.int32())], ["label_id", "text_id", "at"])

    types = {f.name: f.dataType.simpleString() for f in [*labels.schema, *texts.schema]}
    folded = texts.select("text_id", F.lower("text").alias("text")).filter("text is not null and text_id is not null")
    return folded.mapInArrow(walk, f"label_id {types['label_id']}, text_id {types['text_id']}, at int")


def mention_join(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """label_id, text_id, at: labels (label_id, label) and the texts (text_id, text) that hold them, with the first place, from 0. Without regard to case; labels without text are in none. No pair is lost or doubled."""
    few = labels.select("label_id", F.lower(F.trim("label")).alias("label")).filter("label <> ''").distinct().withColumn("bounded", bounded(F.col("label"))).limit(_FEW_LABELS + 1).toArrow()
    if len(few) <= _FEW_LABELS:
        return _walked(few, labels, texts)
    wanted = hold(labels.select("label_id", F.lower(F.trim("label")).alias("label")).filter("label <> ''"), bounded=bounded(F.lower(F.trim("label"))))
    folded = texts.select("text_id", F.lower("text").alias("text")).filter("text is not null")
    short = F.least(F.length("label"), F.lit(3))
    keyed = wanted.select("*", F.explode(F.when(F.col("bounded"), F.array_distinct(F.regexp_extract_all("label", F.lit("[a-z0-9]+"), F.lit(0)))).when(short == 1, F.array("label")).when(short == 2, _grams(F.col("label"), [2])).otherwise(_grams(F.col("label"), [3]))).alias("key"))
    words = folded.select("text_id", F.lit(True).alias("bounded"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)))).alias("key"))
    # at most three lengths; texts are cut into pieces only where a label needs them
    sizes = sorted(r["n"] for r in wanted.filter(~F.col("bounded")).select(short.alias("n")).distinct().collect())
    parts = words if not sizes else words.unionByName(folded.select("text_id", F.lit(False).alias("bounded"), F.explode(_grams(F.col("text"), sizes)).alias("key")))
    used = parts.join(keyed.select("bounded", "key").distinct(), ["bounded", "key"], "left_semi")
    often = used.groupBy("bounded", "key").agg(F.count("*").alias("n"))
    rarest = keyed.join(often, ["bounded", "key"]).groupBy("label_id", "label", "bounded").agg(F.min(F.struct("n", "key"))["key"].alias("key"), F.count("*").alias("have"), F.first("label").alias("_l"))
    # a label of which some part is in no text is in no text
    whole = keyed.groupBy("label_id", "label", "bounded").agg(F.count("*").alias("parts"))
    open_ = rarest.join(whole, ["label_id", "label", "bounded"]).filter("have = parts").select("label_id", "label", "bounded", "key")
    pairs = used.join(apart(open_), ["bounded", "key"]).select("label_id", "label", "bounded", "text_id").join(apart(folded), "text_id")
    edge = F.regexp_instr("text", F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("label"), F.lit(r"\E(?![a-z0-9])")))
    return hold(pairs.select("label_id", "text_id", "text", "label", "bounded"), at=F.when(F.col("bounded"), edge).otherwise(F.instr("text", F.col("label"))) - 1).filter("at >= 0").select("label_id", "text_id", "at")


def find_terms(glossary: DataFrame, questions: DataFrame) -> DataFrame:
    """The term that a question asks to define: text_id, term, score. glossary: term, alias; questions: text_id, text.

    Only questions with a marker of definition have one. An alias scores its length, 50 more at the start, 30 more right after a marker and 30 right before one; the best must reach 30. Of equal terms the first in order.
    """
    asks = let(F.lower("text"), lambda t: F.exists(F.array(*map(F.lit, DEFINITION_MARKERS)), lambda m: F.contains(t, m)))
    asked = questions.filter(asks)
    alias = glossary.select(F.concat_ws("\x01", "term", "alias").alias("label_id"), "term", "alias")
    found = mention_join(alias.select("label_id", F.col("alias").alias("label")), asked).join(alias, "label_id").join(asked.select("text_id", F.lower("text").alias("text")), "text_id")
    size = F.length("alias")
    any_marker = "(?:" + "|".join(DEFINITION_MARKERS) + ")"
    before, after = F.substring(F.col("text"), F.lit(1), F.col("at")), F.substring(F.col("text"), F.col("at") + size + 1, F.length("text"))
    score = size + F.when(F.col("at") <= 2, 50).otherwise(0) + F.when(before.rlike(any_marker + r"[一下这个该\s]*$"), 30).otherwise(0) + F.when(after.rlike(r"^[的在是指为叫做\s]*" + any_marker), 30).otherwise(0)
    best = found.groupBy("text_id", "term").agg(F.max(score).alias("score"))
    order = Window.partitionBy("text_id").orderBy(F.desc("score"), "term")
    return best.withColumn("nth", F.row_number().over(order)).filter("nth = 1 and score >= 30").drop("nth")


def cube_relevance(labels: DataFrame, titles: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, scope_id, relevance: 8 for each series and category that a question mentions, 2 for each title in it, and 2 for each word that it shares with a title (4 words a title at most). Scopes without any are left out.

    labels: scope_id, kind, label (normal keys); titles: scope_id, title_no, title; questions: question_id, text, key (normal key).
    """
    names = labels.filter("label <> ''").select("label").distinct()
    keyed = questions.select(F.col("question_id").alias("text_id"), F.col("key").alias("text"))
    # keys have no blanks: labels of any kind may stand inside a word
    hit = substring_pairs(names.select(F.col("label").alias("label_id"), "label"), keyed)
    mentioned = labels.select("scope_id", "kind", "label").distinct().join(hit, F.col("label") == F.col("label_id")).groupBy(F.col("text_id").alias("question_id"), "scope_id").agg((8 * F.count("*")).alias("points"))
    heads = titles.select("scope_id", "title_no", "title")
    whole = heads.select(F.concat_ws("\x01", "scope_id", F.col("title_no").cast("string")).alias("label_id"), "scope_id", F.lower(F.regexp_replace("title", r"(?U)[^\w]+", "")).alias("label")).filter("label <> ''")
    inside = substring_pairs(whole.select("label_id", "label"), keyed).join(whole.select("label_id", "scope_id"), "label_id").groupBy(F.col("text_id").alias("question_id"), "scope_id").agg((2 * F.count("*")).alias("points"))
    stop = F.array(*map(F.lit, STOPWORDS))
    tokens = lambda c: F.explode(F.array_except(semantic_tokens(F.col(c)), stop)).alias("token")
    shared = heads.select("scope_id", "title_no", tokens("title")).join(questions.select("question_id", tokens("text")), "token").groupBy("question_id", "scope_id", "title_no").agg(F.count("*").alias("n"))
    common = shared.groupBy("question_id", "scope_id").agg(F.sum(2 * F.least("n", F.lit(4))).alias("points"))
    return mentioned.unionByName(inside).unionByName(common).groupBy("question_id", "scope_id").agg(F.sum("points").alias("relevance"))


def substring_pairs(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """label_id, text_id of labels that are anywhere in a text, also inside a word: by their rarest three characters."""
    short = F.least(F.length("label"), F.lit(3))
    keyed = labels.filter("label <> ''").select("*", F.explode(F.when(short == 1, F.array("label")).when(short == 2, _grams(F.col("label"), [2])).otherwise(_grams(F.col("label"), [3]))).alias("key"))
    sizes = sorted(r["n"] for r in labels.filter("label <> ''").select(short.alias("n")).distinct().collect())  # at most three
    if not sizes:
        return labels.select("label_id").limit(0).join(texts.select("text_id").limit(0))
    parts = texts.select("text_id", F.explode(_grams(F.col("text"), sizes)).alias("key")).join(keyed.select("key").distinct(), "key", "left_semi")
    often = parts.groupBy("key").agg(F.count("*").alias("n"))
    rarest = keyed.join(often, "key").groupBy("label_id", "label").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    # a label of up to three characters is its own key
    return parts.join(rarest, "key").join(texts, "text_id").filter((F.length("label") <= 3) | F.contains("text", F.col("label"))).select("label_id", "text_id").distinct()
