"""Quality rules as a learned decision list.

Statistics of whole texts are counted once. From labelled rows, sequential covering learns rules for
bad texts: a rule grows by the threshold that gains most until it covers no good row of the growing
part, is cut back to the length that does best on the pruning part, and takes its rows away; rules
follow until one isn't precise enough. The list is a Spark conditional expression over the statistics.

Learning uses the documents of at most ``sample_rows`` labels, those of least hash of doc_id; where a doc_id
has many texts, ``sample_rows`` of them by hash. Everything else covers all rows.

Nulls and ties: null texts have no words, labels that are null or without document are not used, and
without any bad label the list is empty and keeps all. Repeated rows are judged alike, and teach once, as
do repeated labels. Empty tables give an empty result. Statistics replace columns of the same name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diarist.scratch import materialize
from llm import text as T
from llm.sampling import least_hashed

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_upper", "n_digits",
    "n_marks", "n_distinct_words", "n_echoes",
]
# What the rules may ask, as Spark expressions over the counts: only shares, which don't change with the length of a
# text. The share of distinct words does, so it is counted but not asked.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_bytes, 1)",
    "digit_share": "n_digits / greatest(n_bytes, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "echo_share": "n_echoes / greatest(n_words, 1)",
}


def _set_of(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SYMBOLS, MARKS = _set_of(b"#*$%&|<>"), _set_of(b".,;:!?")


def text_counts(column) -> dict[str, np.ndarray]:
    """COUNTS of each text of a column."""
    data, offsets = T.buffer(column)
    n = len(offsets) - 1
    member = T.NOT_BLANK[data]

    def per_text(flags):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    prefix = T.prefix_hash(data)
    starts, ends, texts = T.spans(member, offsets)
    words = T.span_hash(prefix, starts, ends)
    salt = T.mix(np.arange(1, n + 1).astype(np.uint64))
    own = words ^ salt[texts]

    def distinct(keys, of):
        order = np.argsort(keys)
        first = np.ones(len(keys), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        return np.bincount(of[order[first]], minlength=n)

    grams = T.gram_hash(words, 5)
    inside = np.flatnonzero(texts[: len(grams)] == texts[4 : 4 + len(grams)])
    keys = grams[inside] ^ salt[texts[inside]]
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice = inside[order[same[1:] | same[:-1]]]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + 5, -1)
    covered = np.cumsum(step)[:-1] > 0

    line_starts, line_ends, line_texts = T.spans(data != 10, offsets)
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(member, out=upto[1:])
    worded = upto[line_ends] > upto[line_starts]
    line_starts, line_ends, line_texts = line_starts[worded], line_ends[worded], line_texts[worded]
    lines = T.span_hash(prefix, line_starts, line_ends) ^ salt[line_texts]
    n_lines = np.bincount(line_texts, minlength=n)

    echo = (words[1:] == words[:-1]) & (texts[1:] == texts[:-1])
    return {
        "n_words": np.bincount(texts, minlength=n),
        "word_chars": per_text(member & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(SYMBOLS[data]),
        "n_dup_lines": n_lines - distinct(lines, line_texts),
        "n_repeat_words": np.bincount(texts[covered], minlength=n),
        "n_lines": n_lines,
        "n_bytes": np.diff(offsets),
        "n_upper": per_text((data >= 65) & (data <= 90)),
        "n_digits": per_text((data >= 48) & (data <= 57)),
        "n_marks": per_text(MARKS[data]),
        "n_distinct_words": distinct(own, texts),
        "n_echoes": np.bincount(texts[1:][echo], minlength=n),
    }


def statistics(docs: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with COUNTS."""
    docs = docs.drop(*COUNTS)

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text", part_bytes):
                found = text_counts(part.column("text"))
                arrays = [pa.array(found[c].astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *COUNTS])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} long" for c in COUNTS]
    return docs.mapInArrow(run, ", ".join(names))


def labelled_sample(counted: DataFrame, labels: DataFrame, sample_rows: int):
    """Features and whether the label is bad, of a bounded number of labelled rows."""
    marks = labels.where("quality is not null and doc_id is not null")
    few = least_hashed(marks, "doc_id", sample_rows, "quality").select(
        F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_bad")
    )
    # At most sample_rows rows of two numbers are broadcast.
    rows = counted.select("doc_id", *COUNTS).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    rows = rows.select("_id", "_bad", *(F.expr(e).alias(f"_{name}") for name, e in FEATURES.items())).distinct()
    rows = materialize(rows, "rule-sample")
    got = least_hashed(rows, rows.columns, sample_rows).collect()
    got = [[*r[2:], r[1]] for r in sorted(got, key=lambda r: (str(r[0]), *r[1:]))]
    x = np.array([list(r)[:-1] for r in got], float).reshape(-1, len(FEATURES))
    return x, np.array([r[-1] for r in got], bool)


def _covers(x, rule):
    out = np.ones(len(x), bool)
    for column, above, threshold in rule:
        out &= x[:, column] > threshold if above else x[:, column] <= threshold
    return out


def _grow(x, bad, cuts, most):
    rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for column, values in enumerate(cuts):
            of_bad = np.sort(x[inside & bad, column])
            of_good = np.sort(x[inside & ~bad, column])
            under_bad = np.searchsorted(of_bad, values, "right")
            under_good = np.searchsorted(of_good, values, "right")
            for above in (False, True):
                pp = p - under_bad if above else under_bad
                nn = n - under_good if above else under_good
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), 0)
                i = int(np.argmax(gains)) if len(gains) else -1
                if i >= 0 and gains[i] > gain:
                    best, gain = (column, above, float(values[i])), gains[i]
        if best is None:
            break
        rule.append(best)
        inside &= _covers(x, [best])
    return rule


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 16, most_terms: int = 4, precision: float = 0.97,
          least_rows: int = 5, levels: int = 128) -> list[list[tuple[int, bool, float]]]:
    """Rules for bad rows, in order; each is a list of (feature, above, threshold).

    Every third row prunes, the others grow. Thresholds lie at up to ``levels`` quantiles, halfway to
    the next value.
    """
    rules, left = [], np.ones(len(x), bool)
    prunes = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (bad & left & ~prunes).any():
        grow, prune = left & ~prunes, left & prunes
        cuts = []
        for column in range(x.shape[1]):
            seen = np.unique(x[grow, column])
            between = (seen[1:] + seen[:-1]) / 2
            if len(between) > levels:
                between = np.unique(np.quantile(x[grow & bad, column], np.linspace(0, 1, levels)))
                between = between[(between > seen[0]) & (between < seen[-1])]
                after = seen[np.minimum(np.searchsorted(seen, between, "right"), len(seen) - 1)]
                between = np.unique(np.concatenate([(between + after) / 2, (seen[1:9] + seen[:8]) / 2]))
            cuts.append(between)
        rule = _grow(x[grow], bad[grow], cuts, most_terms)
        if not rule:
            break

        def worth(n_terms):
            hit = _covers(x[prune], rule[:n_terms])
            p, n = (bad[prune] & hit).sum(), (~bad[prune] & hit).sum()
            precise = bad[left & _covers(x, rule[:n_terms])].mean() >= precision
            return precise, (p - n) / max(p + n, 1), -n_terms

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        hit = left & _covers(x, rule)
        if hit.sum() < least_rows or bad[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules) -> Column:
    """The decision list over COUNTS: true where a text is good."""
    names = list(FEATURES)

    def term(column, above, threshold):
        value = F.expr(FEATURES[names[column]])
        return value > threshold if above else value <= threshold

    out = F
    for rule in rules:
        out = out.when(reduce(lambda a, b: a & b, (term(*t) for t in rule)), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def describe(rules) -> list[str]:
    """The rules in words."""
    names = list(FEATURES)
    return [" and ".join(f"{names[c]} {'>' if up else '<='} {t:.6g}" for c, up, t in rule) for rule in rules]


def base_failed() -> Column:
    """Fixed rules that hold beside the learned ones."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(counted: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``. ``counted`` is read twice, so write it first."""
    rules = learn(*labelled_sample(counted, labels, sample_rows))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
