"""Periodic run detection: the maximal stretches of a text's words that repeat with a period.

A run is a stretch of consecutive words with smallest period q, at least MIN_LENGTH words and two
periods long, that no neighbouring word extends with that period.

The method, per text: a suffix automaton of the words, whose suffix links make a tree. Words are
appended one by one; the state of each prefix is accessed as in a link-cut tree: the path from the
root is one preferred path afterwards, coloured with the word's number, the last place where the
path's strings end. What the access recolours comes in segments of one colour each. A segment of
strings over `low` to `high` words, last seen at an end p words back, means a square of period p
that ends here if low < p <= high (p <= low: its root is itself a repetition). In a run of period p
every word from the second period's last on ends such a square, and nothing else does, so squares
at consecutive ends are extended to runs by counting on. The automaton is finished before the
accesses, so the tree does not change and preferred paths lie on its heavy paths, each as a stack
of segments: an access visits O(log n) heavy paths and removes the segments that it recolours.

Before that, each stretch of a text is narrowed to the words that lie in a repeated gram of half
of MIN_LENGTH words, again and again until nothing goes: all words of a run do. This is exact, as
equal grams have equal hashes; a hash that two grams share only leaves more to the automaton.

Texts need no shuffle, and a text is held by one task with an automaton of its repetitive stretches
(some 0.5 KB a word). Words are those between blanks, unchanged. Results for odd input: null and
empty texts, and texts of blanks, have no words and no runs; very long texts are processed whole;
runs of one start are told apart by their period, so there are no ties; repeated rows are each
answered; an empty table gives no rows; other columns pass through, but for those with a name that
this operator returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.llm import common as c

MIN_LENGTH = 12
ADDED = ("n_words", "runs", "collapsed")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repetitive(hashes: np.ndarray, text: np.ndarray, gram: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of stretches that may hold runs; words are numbered as they lie in `hashes`."""
    place, part = np.arange(len(hashes)), text.astype(np.int64)
    while len(place):
        n = len(place) - gram + 1
        if n <= 0:
            return []
        whole = part[:n] == part[gram - 1 :]
        grams = c.mixed(c.gram_hashes(hashes[place], gram) ^ c.mixed(part[:n].astype(np.uint64) + np.uint64(1)))
        kept = np.sort(grams[whole])
        twice = np.unique(kept[1:][kept[1:] == kept[:-1]])
        if not len(twice):
            return []
        at = np.flatnonzero(whole & c.is_member(grams, twice))
        edge = np.zeros(len(place) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + gram, -1)
        covered = np.cumsum(edge[:-1]) > 0
        new = np.ones(len(place), bool)
        new[1:] = (part[1:] != part[:-1]) | ~covered[:-1]
        stretch = np.cumsum(new & covered)
        size = np.bincount(stretch[covered], minlength=stretch[-1] + 1)
        covered &= size[stretch] >= 2 * gram
        if covered.all() and len(np.unique(part)) == len(np.unique(stretch)):
            break
        place, part = place[covered], stretch[covered]
    return [(int(text[place[s]]), int(place[s]), int(place[e - 1]) + 1) for s, e in c.run_bounds(part)]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton: longest string and suffix link of each state, and the states of all prefixes."""
    following: list[dict[int, int]] = [{}]
    longest, link, prefixes, last = [0], [-1], [], 0
    for n, word in enumerate(words, 1):
        state = len(longest)
        longest.append(n)
        following.append({})
        at = last
        while at >= 0 and word not in following[at]:
            following[at][word] = state
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            to = following[at][word]
            if longest[to] == longest[at] + 1:
                link.append(to)
            else:
                copy = state + 1
                link += [copy, link[to]]
                longest.append(longest[at] + 1)
                following.append(following[to].copy())
                link[to] = copy
                while at >= 0 and following[at].get(word) == to:
                    following[at][word] = copy
                    at = link[at]
        prefixes.append(state)
        last = state
    return longest, link, prefixes


def heavy_heads(longest: list[int], link: list[int]) -> list[int]:
    """For each state the highest state of its heavy path in the tree of suffix links."""
    order = np.argsort(longest, kind="stable").tolist()
    size, heavy, head = [1] * len(link), [-1] * len(link), list(range(len(link)))
    for v in reversed(order[1:]):
        up = link[v]
        size[up] += size[v]
        if heavy[up] < 0 or size[v] > size[heavy[up]]:
            heavy[up] = v
    for v in order:
        if heavy[v] >= 0:
            head[heavy[v]] = head[v]
    return head


def runs_of(words: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    longest, link, prefixes = automaton(words)
    head = heavy_heads(longest, link)
    # of a heavy path: segments (longest string, last end) from the deepest up to the path's head
    segments: dict[int, list[tuple[int, int]]] = {}
    open_runs: dict[int, list[int]] = {}
    out = []

    def close(period: int, first: int, end: int) -> None:
        start = first - 2 * period + 1
        if end - start + 1 >= min_length:
            out.append((start, end - start + 1, period))

    for i, state in enumerate(prefixes):
        while state > 0:
            top, high = head[state], longest[state]
            path = segments.setdefault(top, [])
            low = longest[link[top]] if top else 0
            while path:
                reach, end = path[-1]
                period = i - end
                if low < period <= (reach if reach < high else high):
                    run = open_runs.get(period)
                    if run and run[1] == i - 1:
                        run[1] = i
                    else:
                        if run:
                            close(period, *run)
                        open_runs[period] = [i, i]
                if reach > high:
                    break
                low = reach
                path.pop()
            path.append((high, i))
            state = link[top]
    for period, run in open_runs.items():
        close(period, *run)
    return sorted(out, key=lambda x: (x[0], x[2]))


def _detected(columns: list[str], min_length: int):
    text_at = columns.index("text")
    gram = (min_length + 1) // 2

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.text_bytes(batch.column(text_at))
            n_words, collapsed = [], []
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, end, part, at in c.slices(data, offsets):
                starts, _, text = c.words(part, at)
                before = np.searchsorted(text, np.arange(end - first))
                stretches = repetitive(c.word_hashes(part, starts), text, gram)
                of: dict[int, list[tuple[int, int]]] = {}
                for t, a, b in stretches:
                    of.setdefault(t, []).append((a - int(before[t]), b - int(before[t])))
                for t in range(end - first):
                    words = part[at[t] : at[t + 1]].tobytes().split()
                    n_words.append(len(words))
                    gone: set[int] = set()
                    for a, b in of.get(t, ()):
                        numbers: dict[bytes, int] = {}
                        own = [numbers.setdefault(x, len(numbers)) for x in words[a:b]]
                        for start, length, period in runs_of(own, min_length):
                            found[first + t].append({"start": a + start, "length": length, "period": period})
                            gone.update(range(a + start + period, a + start + length))
                    if gone:
                        words = [x for i, x in enumerate(words) if i not in gone]
                    collapsed.append(b" ".join(words))
            added = [pa.array(n_words, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, *ADDED])

    return f


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """The rows with n_words, runs (start, length and period in words, by start, then period) and
    collapsed, the words joined by single spaces less those after the first period of a run."""
    columns = [x for x in docs.columns if x not in ADDED]
    docs = docs.select(*columns).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{x}` {t}" for x, t in docs.dtypes) + ", n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.mapInArrow(_detected(columns, min_length), schema)


def planted_periods(text: Column, doc_id: Column) -> Column:
    """The query's texts: where crc32(doc_id) is divisible by 10, the words from the a-th on repeat the first p of them.

    With g the tenth of the crc32 and n words, a is g mod n and p is 1 + (n - a) div (3 + g mod 8).
    Other texts, and those of null doc_ids, are unchanged.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    a = g % n
    p = F.expr("1L") + F.floor((n - a) / (3 + g % 8)).cast("long")
    tail = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(tail, times)), 1, (n - a).cast("int"))
    whole = F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), whole).otherwise(text)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests of runs and collapsed text."""
    texts = docs.select("doc_id", planted_periods(F.col("text").cast("string"), F.col("doc_id")).alias("text"))
    found = find_runs(texts)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    least_last = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    longest = F.array_max(least_last)
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div (-longest.period)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
