"""Quality rules: an ordered decision list learned by sequential covering, applied as one Spark conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.arrow import add_columns, without
from meshwork.llm.sample import PER_CLASS, labelled

WINDOW = 8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lower long, n_digits long, n_marks long, n_lines long"

#: Classes of bytes.
SPACE, SYMBOL, UPPER, LOWER, DIGIT, MARK = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!?"


def _flags(*classes: bytes) -> list[np.ndarray]:
    out = []
    for c in classes:
        table = np.zeros(256, np.int64)
        table[list(c)] = 1
        out.append(table)
    return out


def repeated(words: list[list[bytes]], window: int = WINDOW) -> list[int]:
    """For each text's words: how many lie in windows of ``window`` words that the text holds twice or more."""
    lengths = np.array([len(w) for w in words], np.int64)
    n = int(lengths.sum())
    if not n:
        return [0] * len(words)
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for t in words for w in t), np.int64, n)
    doc = np.repeat(np.arange(len(words)), lengths)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    left = bounds[doc + 1] - np.arange(n)  # words from here to the text's end
    at = np.flatnonzero(left >= window)
    if not len(at):
        return [0] * len(words)
    hashed = np.zeros(len(at), np.uint64)
    for j in range(window):
        hashed = (hashed ^ (rank[at + j].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(29)
    order = np.lexsort((hashed, doc[at]))
    own, of = hashed[order], doc[at][order]
    same = (own[1:] == own[:-1]) & (of[1:] == of[:-1])
    for j in range(window):  # equal hashes are confirmed word by word
        pair = np.flatnonzero(same)
        same[pair] = rank[at[order[pair]] + j] == rank[at[order[pair + 1]] + j]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    cover = np.zeros(n + 1, np.int64)
    starts = at[order[twice]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:n] > 0)])
    return (hit[bounds[1:]] - hit[bounds[:-1]]).tolist()


def _make():
    tables = _flags(SYMBOL, UPPER, LOWER, DIGIT, MARK)
    blank = np.ones(256, np.int64)  # code points begin at bytes that do not continue one
    blank[list(SPACE)] = 0
    blank[128:192] = 0

    def work(texts: list[bytes | None]) -> list:
        words = [t.split() if t else [] for t in texts]
        ends = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        sums = [np.add.reduceat(table[raw], ends[:-1]).tolist() if texts else [] for table in (blank, *tables)]
        lines, copies = [], []
        for t in texts:
            own = [x for x in (t or b"").split(b"\n") if x.strip(SPACE)]
            lines.append(len(own))
            copies.append(len(own) - len(set(own)))
        return [list(map(len, words)), sums[0], sums[1], copies, repeated(words), *sums[2:], lines]

    return work


def with_stats(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics of STATS, over whole texts; a null text has none of anything."""
    return add_columns(docs, STATS, _make, text_col=text_col, keep=keep)


#: What conditions may test, as SQL over the statistics; each is 0 where a text has no words.
ATTRIBUTES = {
    "words": "cast(n_words as double)",
    "chars_a_word": "if(n_words > 0, word_chars / n_words, 0.0)",
    "symbols_a_word": "if(n_words > 0, n_symbols / n_words, 0.0)",
    "marks_a_word": "if(n_words > 0, n_marks / n_words, 0.0)",
    "repeated_share": "if(n_words > 0, n_repeat_words / n_words, 0.0)",
    "copied_lines": "if(n_lines > 0, n_dup_lines / n_lines, 0.0)",
    "upper_share": "if(n_upper + n_lower > 0, n_upper / (n_upper + n_lower), 0.0)",
    "digit_share": "if(word_chars > 0, n_digits / word_chars, 0.0)",
    "words_a_line": "if(n_lines > 0, n_words / n_lines, 0.0)",
}


@dataclass(frozen=True)
class Condition:
    attribute: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(ATTRIBUTES).index(self.attribute)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.expr(ATTRIBUTES[self.attribute])
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Add the condition with the largest information gain for the bad rows until none of the others is covered."""
    rule: Rule = ()
    now = np.ones(len(x), bool)
    while len(rule) < most and (now & ~bad).any() and (now & bad).any():
        p, n = int((now & bad).sum()), int((now & ~bad).sum())
        base, best, gain = np.log2(p / (p + n)), None, 1e-9
        for k, name in enumerate(ATTRIBUTES):
            v = x[:, k]
            for t in np.unique(np.quantile(v[now], np.linspace(0, 1, cuts))):
                for above in (True, False):
                    hit = now & ((v > t) if above else (v <= t))
                    q = int((hit & bad).sum())
                    if q and (g := q * (np.log2(q / int(hit.sum())) - base)) > gain:
                        best, gain = Condition(name, above, float(t)), g
        if best is None:
            break
        rule, now = (*rule, best), now & best.holds(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, cuts: int = 65, least_precision: float = 0.9, least_cover: int = 5, seed: int = 0) -> list[Rule]:
    """Rules for bad rows, in order: each is grown on two thirds of the rows left, pruned on the others, and covers what it then takes.

    Pruning drops final conditions while (p - n) / (p + n) on the pruning rows does not fall. A rule stays if it covers ``least_cover`` rows
    at ``least_precision``; learning ends at the first that does not.
    """
    rules: list[Rule] = []
    left, deal = np.ones(len(x), bool), np.random.default_rng(seed)
    while (left & bad).any() and len(rules) < most_rules:
        part = deal.random(len(x)) < 2 / 3
        rule = _grow(x[left & part], bad[left & part], most_conditions, cuts)

        def worth(r: Rule, rows: np.ndarray = left & ~part) -> float:
            hit = covers(r, x[rows])
            p = int((hit & bad[rows]).sum())
            return (2 * p - int(hit.sum())) / int(hit.sum()) if hit.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = left & covers(rule, x)
        if not rule or hit.sum() < least_cover or (hit & bad).sum() < least_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """An ordered conditional expression: false at the first rule that fits, true if none does."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.attribute} {'>' if c.above else '<='} {c.threshold:.4g}" for c in r) for r in rules]


def learn_rules(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, per_class: int = PER_CLASS) -> list[Rule]:
    """A decision list from the statistics of at most ``per_class`` documents of either label (0: bad), which never hold out rows of ``held_out``."""
    sample = labelled(docs, labels, label, id_col=id_col, text_col=text_col, held_out=held_out, per_class=per_class)
    rows = with_stats(sample, keep=["id", "y"]).select("id", "y", *(F.expr(sql).alias(k) for k, sql in ATTRIBUTES.items())).orderBy("id", "y", *ATTRIBUTES).limit(4 * per_class).collect()
    if not rows:
        return []
    return learn(np.array([[r[k] for k in ATTRIBUTES] for r in rows], float), np.array([r["y"] == 0 for r in rows]))


def judge(docs: DataFrame, rules: list[Rule], *, text_col: str = "text", keep: list[str] | None = None, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """``docs`` with the statistics, base_failed (under ``least_words`` words, or over ``most_repeated`` per cent of them in repeated windows)
    and kept (false if base_failed, else the decision list's verdict).

    Null or empty text: no words, so base_failed. No rules (no labels): kept is the base's verdict. Repeated rows are judged each. Columns
    named like a new one give way.
    """
    kept = without(docs.columns if keep is None else keep, ["base_failed", "kept"])
    rows = with_stats(docs, text_col=text_col, keep=kept)
    rows = rows.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    return rows.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))
