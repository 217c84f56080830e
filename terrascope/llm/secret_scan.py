"""Secret scan: fixed patterns plus a guess-cost search in credential contexts.

Three patterns find base spans (``assign``, ``access``, ``hex``): leftmost
matches that do not overlap, those too short dropped afterwards.  Beyond them,
every value written after a credential word (a wider list of words, separators
and value characters than ``assign`` has) is priced: the least number of guesses
over all its segmentations into words, dates, repeats, keyboard walks,
sequences and brute-force spans, found by dynamic programming over its
positions.  A value that costs ``min_log10_guesses`` or more is reported as
``guess`` unless a base span covers it; ordinary words after "token:" are cheap
and are left alone: the words are ranked by a fixed list, then by the corpus (the
at most ``WORD_TABLE`` words of letters that most documents hold, two at least;
what stands after a credential word does not count, so a repeated secret does not
become a word).  Letters that are no word and long passphrases cost as much as
any other value.

The words are counted in one pass with map-side sums and reach the driver and the
tasks as one bounded table; the scan is one pass with no shuffle.  Pricing is linear in the
length of a value (word and walk segments span at most 32 characters, longer
ones are several segments; repeats span any length).

Offsets count code points, ends are exclusive.  Edge cases: null and empty texts
have no findings; repeated rows are scanned each; empty tables give empty
results; other columns are ignored by ``scan`` and kept by ``mask``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from math import log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, keep_table, ship, strings, with_row

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the same spans as runs [0-9a-f]+ of 32 or more
_CONTEXT = re.compile(
    r"""(?:(?:api|access|private|secret|signing|encryption)[_\x20-]?key|auth[_-]?key"""
    r"""|password|passwd|passphrase|passcode|pwd|secret|token|credentials?|bearer)["']?"""
    r"""(?:\x20*+[:=]+>?|\x20++is(?:\x20*+[:=]+|\x20)|\x20)\x20*+(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'<>]+))""", re.I | re.A)
#: Words without which no pattern with letters in either case can match.
_NEEDS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "credential", "bearer", "key")

#: Frequent password words, most frequent first.
COMMON_WORDS = """password qwerty admin welcome login letmein master dragon monkey football baseball shadow sunshine
princess superman batman trustno hello freedom whatever michael jordan hunter ranger buster soccer harley thomas robert
tigger george charlie andrew michelle jessica pepper daniel access joshua maggie starwars silver william dallas yankees
hammer summer winter spring autumn secret default changeme guest test user root pass token key example sample demo
public private server system database backup temp love money computer internet service company office account manager
support mobile black white green orange purple yellow apple banana cookie flower angel happy lucky magic power""".split()
_KEYBOARD = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_LEET = str.maketrans("4301$5@7!", "aeoissati")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
_DATE_COST, _YEAR_COST = log10(366 * 120), log10(120)
#: Frequent English words.
ENGLISH_WORDS = """the of and to in is that for it with as was on are be this by have from or not at but you they his her
she which will one all would there their what when who make can like time just know take into year your good some could them
see other than then now look only come over think also back after use two how our work first well way even new want because
any these give day most here where world thing things same tell need feel become leave call between never last great small
large found still own under read hand high long place begin while number every near food night live point city play being
required missing invalid expired string value field header name file string return true false null none""".split()
#: Fixed value: words counted from the corpus, at most.
WORD_TABLE = 1 << 16
_LETTERS = re.compile(r"[^\W\d_]{3,32}")
_MAX_SPAN = 32
#: Longest credential word with its separator, about: how far back a value is searched for the next one.
_TAIL = 40
_SEGMENT = log10(2)  # choosing another kind of segment
_WALK_START, _WALK_TURN = log10(47 * 2), log10(4.6)


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    at = {c: (y, x) for y, row in enumerate(_KEYBOARD) for x, c in enumerate(row) if c != " "}
    for c, (y, x) in at.items():
        near[c] = {d for d, (v, u) in at.items() if d != c and (v - y, u - x) in
                   {(0, -1), (0, 1), (1, 0), (1, -1), (-1, 0), (-1, 1)}}
    return near


_NEAR = _neighbours()


def _char_cost(c: str) -> float:
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log10(26)
    return log10(33) if c < "\x80" else log10(100)


def word_ranks(words) -> dict[str, float]:
    """Words by falling frequency to log10 of their rank (from 2)."""
    return {w.lower(): log10(i + 2) for i, w in reversed(list(enumerate(words)))}


_COMMON = word_ranks(COMMON_WORDS)


def guess_cost(value: str, words: dict[str, float] = _COMMON) -> float:
    """log10 of the least number of guesses over all segmentations of ``value``."""
    n = len(value)
    if n == 0:
        return 0.0
    low = value.lower() if len(value.lower()) == n else value
    leet = low.translate(_LEET)
    keys = low.translate(_SHIFTED)
    each = [_char_cost(c) for c in value]
    total = [0.0]
    for c in each:
        total.append(total[-1] + c)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
            if m.end() - i > 4 and value[i:i + 2] in ("19", "20") and value[i:i + 4].isdigit():
                dates.setdefault(i + 4, []).append(i)
    longest = _MAX_SPAN if len(words) > 1000 else min(_MAX_SPAN, max(map(len, words), default=0))
    best = [0.0] * (n + 1)
    same = [0] * 9       # characters up to here that equal the one u places before
    walk = turns = sequence = 0  # length of the walk / sequence that ends here
    step = 0
    for i in range(1, n + 1):
        c = best[i - 1] + each[i - 1]
        for j in range(max(0, i - longest), i - 2):
            rank = words.get(low[j:i])
            swap = 0.0
            if rank is None and leet is not low:
                rank, swap = words.get(leet[j:i]), _SEGMENT
            if rank is not None:
                part = value[j:i]
                case = 0.0 if part == low[j:i] else _SEGMENT if part.isupper() or part[1:] == low[j + 1:i] else (i - j) * _SEGMENT
                c = min(c, best[j] + _SEGMENT + rank + swap + case)
        for j in dates.get(i, ()):
            c = min(c, best[j] + _SEGMENT + (_YEAR_COST if i - j == 4 else _DATE_COST))
        for u in range(1, 9):
            if i <= u:
                break
            same[u] = same[u] + 1 if value[i - 1] == value[i - 1 - u] else 0
            times = (same[u] + u) // u
            if same[u] >= u and times * u >= 3:
                j = i - times * u
                c = min(c, best[j] + _SEGMENT + total[j + u] - total[j] + log10(times))
        if i > 1:
            if keys[i - 1] in _NEAR.get(keys[i - 2], ()):
                walk = walk + 1 if walk else 2
                turns += 1 if walk > 2 and ord(keys[i - 1]) - ord(keys[i - 2]) != ord(keys[i - 2]) - ord(keys[i - 3]) else 0
            else:
                walk = turns = 0
            if walk >= 3:
                span = min(walk, _MAX_SPAN)
                c = min(c, best[i - span] + _SEGMENT + _WALK_START + log10(span) + min(turns, span) * _WALK_TURN)
            d = ord(low[i - 1]) - ord(low[i - 2])
            if d in (1, -1) and low[i - 1].isalnum() and low[i - 2].isalnum():
                sequence = sequence + 1 if sequence and d == step else 2
            else:
                sequence = 0
            step = d
            if sequence >= 3:
                span = min(sequence, _MAX_SPAN)
                c = min(c, best[i - span] + _SEGMENT + _char_cost(value[i - span]) + log10(2 * span))
        best[i] = c
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the fixed patterns, by start then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _NEEDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def context_values(text: str):
    """``(start, end)`` of the values after credential words.  Send ``True`` for a
    value that is a finding: the search goes on after it; else it goes on inside,
    as the value may hold or be the next credential word.  An unquoted value holds
    no white space, so only a word at its end has a value of its own."""
    at = 0
    while m := _CONTEXT.search(text, at):
        k = m.lastindex
        start, end = m.span(k)
        if k == 3:
            end = start + len(m[3].rstrip(".,;:!?)]}&$%*#|"))
        if (yield start, end):
            at = max(end, start + 1)
        else:
            at = start if k < 3 else max(start, m.end() - _TAIL)


def guess_spans(text: str, base: list[tuple[int, int, int]], threshold: float, words: dict[str, float]):
    """``(start, end, log10 guesses)`` of costly values after credential words
    that no base span covers."""
    low = text.lower()
    if not any(w in low for w in _NEEDS):
        return []
    out, after = [], 0
    starts, reach = [b[0] for b in base], []  # reach: the farthest end of the base spans up to each
    for _, _, e in base:
        reach.append(max(e, reach[-1] if reach else 0))
    values = context_values(text)
    taken = None
    while True:
        try:
            start, end = values.send(taken)
        except StopIteration:
            return out
        taken = False
        value = text[start:end]
        if len(value) < 8 or start < after:
            continue
        before = bisect_right(starts, start)
        if before and reach[before - 1] >= end:
            continue
        cost = guess_cost(value, words)
        if cost >= threshold:
            out.append((start, end, cost))
            after, taken = end, True


def corpus_words(docs: DataFrame, text_column: str = "text", most: int = WORD_TABLE) -> list[str]:
    """The words that most documents hold (two at least), most frequent first,
    lower-cased; words in mixed case and values after credential words do not count.
    All words from the least count on that leaves at most ``most`` of them: it comes
    from a histogram of log-spaced counts, so no more rows reach the driver."""
    def run(batches):
        held: dict[str, int] = {}

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                for text in strings(batch.column(0).slice(a, 1000)):
                    low = text.lower()
                    if any(w in low for w in _NEEDS):
                        parts, done = [], 0
                        for start, end in context_values(text):
                            if end > done:
                                parts.append(text[done:max(start, done)])
                                done = end
                        text = " ".join([*parts, text[done:]])
                    for w in {w.lower() for w in set(_LETTERS.findall(text)) if w[1:].islower() or w.isupper()}:
                        held[w] = held.get(w, 0) + 1
                    if len(held) > 200_000:
                        yield emit()
        if held:
            yield emit()

    counts = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    counts = keep_table(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2"), "corpus-words")
    step = F.floor(F.log2(F.col("n")) * 64)
    histogram = counts.groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("low")).collect()
    least, held = None, 0
    for r in sorted(histogram, reverse=True):       # some thousand rows at most
        held += r.c
        if held > most:
            break
        least = r.low
    if least is None:
        return []
    return [w for w, n in sorted(((r.word, r.n) for r in counts.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))]


_FOUND = "array<struct<kind:string,start:int,end:int,log10_guesses:double>>"
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("log10_guesses", pa.float64())]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_log10_guesses: float = 10.0,
         words=COMMON_WORDS) -> DataFrame:
    """``(__row, id, findings)``: findings by start, then assign, access, hex,
    guess; ``log10_guesses`` is null for base spans."""
    ship(docs.sparkSession)
    ranks = word_ranks([*words, *ENGLISH_WORDS, *corpus_words(docs, text_column)])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = []
                for text in strings(part.column(2)):
                    base = base_spans(text)
                    all_ = [(s, k, e, None) for s, k, e in base]
                    all_ += [(s, 3, e, g) for s, e, g in guess_spans(text, base, min_log10_guesses, ranks)]
                    found.append([{"kind": (*KINDS, "guess")[k], "start": s, "end": e, "log10_guesses": g}
                                  for s, k, e, g in sorted(all_, key=lambda x: x[:3])])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, _FOUND_ARROW)],
                                                 names=[ROW, "id", "findings"])

    return with_row(docs, id_column, text_column).mapInArrow(run, f"{ROW} long, id long, findings {_FOUND}")


def mask(docs: DataFrame, text_column: str = "text", length_column: str | None = None, placeholder: str = "<SECRET>",
         min_log10_guesses: float = 10.0, words=COMMON_WORDS) -> DataFrame:
    """``docs`` with every finding replaced (overlapping ones as one); rows,
    order of columns and null texts stay; ``length_column`` is set to the new
    number of code points where a text changed."""
    ship(docs.sparkSession)
    ranks = word_ranks([*words, *ENGLISH_WORDS, *corpus_words(docs, text_column)])
    at = docs.columns.index(text_column)
    length_at = docs.columns.index(length_column) if length_column else None
    kinds = dict(docs.dtypes)

    def masked(text: str) -> str:
        base = base_spans(text)
        spans = sorted([(s, e) for s, _, e in base] +
                       [(s, e) for s, e, _ in guess_spans(text, base, min_log10_guesses, ranks)])
        out, done = [], 0
        for i, (s, e) in enumerate(spans):
            if i and s < done:
                done = max(done, e)
                continue
            out += [text[done:s], placeholder]
            done = e
        return "".join(out) + text[done:] if spans else text

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                columns = list(part.columns)
                old = columns[at].to_pylist()
                new = [None if t is None else masked(t) for t in old]
                columns[at] = pa.array(new, columns[at].type)
                if length_at is not None:
                    was = columns[length_at].to_pylist()
                    columns[length_at] = pa.array([w if t is None or t == o else len(t) for w, o, t in zip(was, old, new)],
                                                  columns[length_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    assert kinds[text_column] == "string"
    return docs.mapInArrow(run, docs.schema)


def span_list(findings: Column, kinds=None) -> Column:
    """Findings as ``kind:start:end``, comma-joined (of ``kinds`` only, if given)."""
    if kinds:
        findings = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of base spans per kind, the digest of the base spans and all spans."""
    found = scan(docs, id_column, text_column)

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS],
        F.sha2(span_list(F.col("findings"), KINDS), 256).alias("base_sha256"),
        span_list(F.col("findings")).alias("spans"))
