"""URL filters: explicit rules first, then a classifier over segmented host names.

The method: a unigram Viterbi search splits each run of letters of host and path into
the most probable words (`freebets` into free, bets), and a multinomial naive Bayes
model over those words scores the URL.  Both models are learned: the unigrams are the word
counts of a table of texts, the classes' word counts those of its labelled rows (1: text of
the kind to block) and of a small labelled list of URL phrases, EXAMPLES, which is a parameter.
Words are counted over all rows on the cluster; what reaches the driver is the `vocabulary`
commonest words, a documented bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

VOCABULARY = 50_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Longer words are not counted, and runs are split into words of at most so many letters.
LONGEST = 24

#: Labelled URL phrases (1: to block), one a row, for kinds of site that running text hardly names.
EXAMPLES = (
    (1, "casino win bonus jackpot"), (1, "slots poker roulette blackjack"), (1, "bets betting odds free"), (1, "lottery gamble money win"), (1, "cheap pills viagra cialis"), (1, "online pharmacy pills discount"),
    (1, "payday loans cheap replica"), (1, "adult video porn sex"), (1, "xxx nude escort x"), (1, "hot girls cam adult"), (1, "spam farm link scam"), (1, "phishing malware spam"), (1, "ads track click tracker"), (1, "ads popunder banner"), (1, "crack warez keygen torrent"),
    (0, "farm market garden"), (0, "track running sports"), (0, "free software guide"), (0, "hot water kitchen"), (0, "video lessons school"), (0, "link library books"), (0, "win tennis match"), (0, "online journal article"), (0, "cheap travel hotel"), (0, "money history museum"),
    (0, "girls school students"), (0, "click here news"), (0, "discount travel"), (0, "odds science research"), (0, "bonus music review"), (0, "cam city weather"), (0, "banner art gallery"), (0, "x ray health"), (0, "crack rock climbing"),
)

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: str | None) -> tuple[str, str]:
    """The parts of `url`; both empty for null and where there is no ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(_LOWER), path


class UrlModel:
    """The segmenter and the classifier.

    `words` counts each word, `classes` (allowed, blocked) how often it is in labelled texts
    of either kind; `prior` is the share of blocked URLs.  A class expects each word in
    proportion to its count in all texts, with the weight of `smoothing` times all words.
    """

    def __init__(self, words: Mapping[str, int], classes: Mapping[str, tuple[int, int]], prior: float = 0.1, threshold: float = 0.5, smoothing: float = 0.02):
        total = sum(words.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in words.items()}
        self.unknown, self.threshold = math.log(10 * total), threshold
        size = [sum(c[k] for c in classes.values()) + smoothing * total for k in (0, 1)]
        chance = lambda w, c, k: math.log((c[k] + smoothing * words[w]) / size[k])
        #: log odds that a word gives for blocked; words of no labelled text give none
        self.odds = {w: chance(w, c, 1) - chance(w, c, 0) for w, c in classes.items()}
        self.start = math.log(prior) - math.log(1 - prior)

    def segment(self, run: str) -> list[str]:
        """The most probable split of a run of letters; of equally probable ones that with the longest last word.

        An unknown word is ten times less probable than a word seen once, and tenfold less with each letter.
        """
        best, last = [0.0], [0]
        for end in range(1, len(run) + 1):
            cost, start = math.inf, end - 1
            for begin in range(max(0, end - LONGEST), end):
                w = run[begin:end]
                c = self.cost.get(w)
                c = best[begin] + (self.unknown + math.log(10) * len(w) if c is None else c)
                if c < cost:
                    cost, start = c, begin
            best.append(cost)
            last.append(start)
        out, end = [], len(run)
        while end:
            out.append(run[last[end] : end])
            end = last[end]
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        labels = host.split(".")
        names = ".".join(labels[:-1]) if len(labels) > 1 else host  # the top-level name says nothing
        return [w for run in re.findall(r"[a-z]+", f"{names}/{path.translate(_LOWER)}") for w in _segment(self, run)]

    def score_tokens(self, tokens: Sequence[str]) -> float:
        """Probability of blocked."""
        x = self.start + sum(self.odds.get(t, 0.0) for t in tokens)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


@lru_cache(maxsize=100_000)
def _segment(model: UrlModel, run: str) -> tuple[str, ...]:
    return tuple(model.segment(run))


def word_counts(texts: DataFrame, text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """(word, n, allowed, blocked) of the lower-case runs of at most LONGEST letters a-z in all texts.

    `allowed` and `blocked` count a word in rows of label 0 and 1; rows without a label count in n alone.
    """
    label = F.col(label_col) if label_col else F.lit(None)
    # a row gives each of its words once, with its count, so that long texts don't grow into rows of words
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+"), lambda w: (w != "") & (F.length(w) <= LONGEST))
    flat = texts.select(F.explode(words).alias("word"), label.alias("label"))
    count = lambda k: F.count(F.when(F.col("label") == k, 1))
    return flat.groupBy("word").agg(F.count("*").alias("n"), count(0).alias("allowed"), count(1).alias("blocked"))


def fit(texts: DataFrame, text_col: str = "text", label_col: str = "label", vocabulary: int = VOCABULARY, min_count: int = 2, examples: Sequence[tuple[int, str]] = EXAMPLES, **options) -> UrlModel:
    """A model from all rows of `texts` and the labelled phrases of `examples`.

    Its words are the commonest that occur `min_count` times, at most `vocabulary` of them
    (words of about one count are taken together or not at all), and those of the phrases.
    Null texts and an empty table give no words.
    """
    found = materialize(word_counts(texts, text_col, label_col).filter(F.col("n") >= min_count), "words")
    # counts to 1,000, and ranges of a sixty-fourth of a factor e above
    level = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.lit(1000) + F.floor(F.log(F.col("n") / 1000) * 64))
    least, total = math.inf, 0
    for r in sorted(found.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):  # about 2,500 rows at most
        total += r["words"]
        if total > vocabulary:
            break
        least = r["level"]
    rows = found.filter(level >= least).collect() if least < math.inf else []
    counts = {r["word"]: [r["n"], r["allowed"], r["blocked"]] for r in rows}
    for label, phrase in examples:
        for w in phrase.split():
            own = counts.setdefault(w, [0, 0, 0])
            own[0] += 1
            own[1 + label] += 1
    return UrlModel({w: c[0] for w, c in counts.items()}, {w: (c[1], c[2]) for w, c in counts.items() if c[1] or c[2]}, **options)


def parse_rules(rules: Sequence[tuple[str, str]]) -> list[Rule]:
    """(verdict, "host/path") pairs, the longest first; of equally long ones allow goes before block."""
    out = []
    for verdict, text in rules:
        host, slash, path = text.partition("/")
        if verdict not in ("allow", "block") or not slash:
            raise ValueError(f"not a rule: {verdict} {text}")
        out.append((verdict, host.lower(), slash + path))
    return sorted(out, key=lambda r: (-len(r[1] + r[2]), r))


def match(host: str, path: str, rules: list[Rule]) -> Rule | None:
    """The longest rule whose host is `host` or above it and whose path begins `path`."""
    return next((r for r in rules if path.startswith(r[2]) and (host == r[1] or host.endswith(f".{r[1]}"))), None)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score, tokens) for every row of `pages`.

    Null URLs and those without :// have an empty host and path, hence no rule and the
    prior as score.  A score over the model's threshold is block.  Repeated rows each return
    a row; an empty table gives an empty result; other columns aren't read.  URLs of any
    length are judged whole.  Rows never leave their partition, so hot hosts don't matter.
    """
    listed, shared = parse_rules(rules), pages.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, path = host_and_path(url)
                rule = match(host, path, listed)
                tokens = model.tokens(host, path)
                score = model.score_tokens(tokens)
                verdict = rule[0] if rule else "block" if score > model.threshold else "allow"
                out.append((page, host, path, rule and rule[1] + rule[2], verdict, round(score, 6), tokens))
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
            names = ["page_id", "host", "path", "rule", "verdict", "score", "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    cols = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"))
    return cols.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, score double, tokens array<string>")
