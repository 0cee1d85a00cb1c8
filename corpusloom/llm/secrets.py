"""Secret scans: fixed patterns, and the novelty of strings in sensitive places under a primed compressor.

A candidate is a string that follows a sensitive word closely and is no base match. A zstandard compressor is primed with
an identifier dictionary and the text around the candidate, as raw content; the candidate's marginal compressed bytes are
what it costs beyond an empty input. A string that costs nearly what its characters cost in random order without a primer
is found in neither dictionary nor surroundings, does not repeat itself, and is reported; its own length is no measure, as
random strings of a small alphabet shrink from 64 characters on. Candidates run to their own end. After "private key" the
body may stand on the following lines.

Texts are scanned whole where they are read: nothing is shuffled, and a document without sensitive words or hex digits in
a row leaves after one vectorised search.

Defined results: a null or empty text has no spans; offsets count code points; equal starts go by kind as listed;
repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, table
from corpusloom.session import ship

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
#: Words whose neighbourhood is sensitive.
SENSITIVE = (
    "password passwd pwd passphrase secret token apikey api_key api-key access_key credential bearer authorization "
    "private_key private-key signing_key encryption_key client_secret session_id auth_token refresh_token webhook "
    "connection_string jwt oauth"
).split() + ["private key"]
NEAR = re.compile(r"(?i:" + "|".join(sorted(map(re.escape, SENSITIVE), key=len, reverse=True)) + ")", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_BREAK, _LINE = r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*", r"[A-Za-z0-9+/=_]"
_END = r"(?=[\x20\t]*(?:[\r\n\"'\\]|\Z))"
#: After "private key": rest of its line, headers, and lines of a body; a line that is one plain word ends it.
BODY = re.compile(
    rf"[-:=\"'\x20\t]*{_BREAK}(?:[A-Za-z-]+:[^\n\\]*{_BREAK})*(?:{_BREAK})?"
    rf"({_LINE}{{16,}}+(?:{_BREAK}(?![A-Z]?[a-z]+{_END}){_LINE}++{_END})*){_END}"
)
#: Identifiers that code is made of, the primer of the compressor.
IDENTIFIERS = (
    "abstract access account address admin application argument array assert async attribute authorization await "
    "backend base64 boolean buffer bytes callback certificate channel class client cluster column config configuration "
    "connection const constructor container content context controller cookie create credential database default "
    "delete description development directory document domain element email enable encoding endpoint environment error "
    "example exception expires export extends factory false field filename filter float format frontend function "
    "gateway generate github global handler hash header hostname http https identifier implements import index "
    "initialize input instance integer interface internal iterator javascript json kubernetes lambda language length "
    "library license listener local localhost location logger manager master message metadata method middleware "
    "migration model module namespace network null number object operator option order output package parameter parent "
    "parse password path pattern payload permission placeholder plugin pointer policy private process production "
    "profile project promise property protected protocol provider public python query queue readonly record redirect "
    "refresh register release remote repository request require resource response result return revision router "
    "runtime schema script secret security self sequence server service session setting signature source static status "
    "storage stream string struct super system table target template terminal testing thread timeout timestamp token "
    "transaction transform transport true undefined update upload user username utils validate value variable vector "
    "version virtual visible volume webhook widget window wrapper www xml yaml your-api-key-here changeme xxxxxxxx 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
AROUND, REACH, LONG, BACK, NOVEL_SHARE, ORDERS = 1024, 48, 1024, 65_536, 0.9, 8
#: Bytes of a block of one letter, which a string pays once.
BARE = 8
_MAY_HOLD = "(?i)passw(or)?d|secret|token|api[_-]?key|" + "|".join(
    re.escape(s) for s in SENSITIVE if s not in ("password", "passwd", "secret", "token")
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(found)


def marginal_bytes(candidate: str, around: str) -> int:
    """What the candidate costs a compressor that knows the identifiers and the surroundings."""
    primer = zstandard.ZstdCompressionDict(
        (IDENTIFIERS + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    compressor = zstandard.ZstdCompressor(
        level=6, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return len(compressor.compress(candidate.encode())) - len(compressor.compress(b""))


def costs(string: str, around: str) -> tuple[int, int]:
    """What the string costs, and what its characters cost in random order and without a primer."""
    plain = zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False, write_dict_id=False)
    mixed, order, alone = list(string), random.Random(0), len(string)
    for _ in range(ORDERS):  # the least of some orders, for near 64 characters an order may by chance not shrink
        order.shuffle(mixed)
        alone = min(alone, len(plain.compress("".join(mixed).encode())) - len(plain.compress(b"")))
    return marginal_bytes(string, around), alone


def is_novel(string: str, around: str) -> bool:
    """Whether the string costs NOVEL_SHARE of what its characters cost in random order and without a primer."""
    cost, alone = costs(string, around)
    return cost >= NOVEL_SHARE * alone


class LongRun:
    """Verdicts on the strings that start anywhere in a run and reach to its end, each from all its characters. The costs of blocks of LONG characters are
    worked out once and summed from the end; a string adds its own part of the block that it starts in. A block knows BACK characters before it."""

    def __init__(self, text: str, start: int, limit: int):
        end = limit
        while end > start and text[end - 1] in ".=~-":
            end -= 1
        self.text, self.end, self.limit = text, end, limit
        self.bounds = list(range(start, max(start + 1, end - LONG + 1), LONG))
        self.after = [(0, 0)] * (len(self.bounds) + 1)
        outside = text[end : end + AROUND]
        for i in range(len(self.bounds) - 1, 0, -1):
            low, high = self.bounds[i], self.bounds[i + 1] if i + 1 < len(self.bounds) else end
            cost, alone = costs(text[low:high], text[max(0, low - BACK) : low] + outside)
            self.after[i] = (self.after[i + 1][0] + max(0, cost - BARE), self.after[i + 1][1] + max(0, alone - BARE))
        self.last = [next((i for i in range(end - 1, start - 1, -1) if test(text[i])), -1) for test in (str.islower, str.isupper, str.isdigit)]

    def kinds(self, start: int) -> int:
        return sum(at >= start for at in self.last)

    def is_novel(self, start: int) -> bool:
        i = bisect_right(self.bounds, start)
        stop = self.bounds[i] if i < len(self.bounds) else self.end
        cost, alone = costs(self.text[start:stop], self.text[max(0, start - AROUND) : start] + self.text[self.end : self.end + AROUND])
        return cost + self.after[i][0] >= NOVEL_SHARE * (alone + self.after[i][1])


class Spans:
    """Disjoint spans in order, of which one is found by bisection."""

    def __init__(self, held: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(held):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meet(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def novel_spans(text: str, held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of incompressible strings that start within REACH of a sensitive word, apart from held spans; a string that
    overlaps one that is found is not found again.

    Every start is judged, once, and work follows the length of the text: runs are found once, a body is looked at from its first word, and the strings that
    end with a run of more than 2 * LONG characters share the costs of its blocks.
    """
    taken, found = Spans(held), []
    words = list(NEAR.finditer(text))
    runs = [m.span() for m in CANDIDATE.finditer(text)] if words else []
    ends = [end for _, end in runs]

    def judge(start: int, end: int, string: str) -> None:
        kinds = sum(any(map(test, string)) for test in (str.islower, str.isupper, str.isdigit))
        if len(string) < 16 or kinds < 2 or taken.meet(start, end):
            return
        if is_novel(string, text[max(0, start - AROUND) : start] + text[end : end + AROUND]):
            taken.add(start, end)
            found.append((start, 3, end))

    body = 0
    for word in words:
        if word[0].lower().startswith("private") and word.end() >= body and (m := BODY.match(text, word.end())):
            body = m.end(1)
            judge(m.start(1), m.end(1), re.sub(r"\s|\\[rn]", "", m[1]))
    seen: set[int] = set()
    long: LongRun | None = None
    for word in words:
        at, last = word.end(), word.end() + REACH
        k = bisect_right(ends, at)
        while k < len(runs) and max(at, runs[k][0]) <= last:
            start, end = max(at, runs[k][0]), runs[k][1]
            k += 1
            if end - start < 16:
                continue
            if "\n" in text[word.end() : start]:
                break
            if start in seen:
                continue
            seen.add(start)
            low = runs[k - 1][0]
            if end - low < 2 * LONG:
                string = text[start:end].rstrip(".=~-")
                judge(start, start + len(string), string)
                continue
            if long is None or not long.bounds[0] <= start < long.limit:
                long = LongRun(text, low, end)
            if long.end - start >= 16 and long.kinds(start) >= 2 and not taken.meet(start, long.end) and long.is_novel(start):
                taken.add(start, long.end)
                found.append((start, 3, long.end))
    return found


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each in order."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def _suspects(column: pa.Array) -> list[str | None]:
    """The texts that may hold a span, None for the others."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    may = pc.or_(
        pc.match_substring_regex(column, _MAY_HOLD),
        pc.or_(pc.match_substring(column, "AKIA"), pc.match_substring_regex(column, "[0-9a-f]{32}")),
    )
    held = iter(column.filter(may).to_pylist())  # if_else reads other bytes where a slice's texts don't begin its buffer
    return [next(held) if m else None for m in may.to_pylist()]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, count of the added ones."""
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for text in _suspects(batch.column("text")):
                if text is None:
                    rows.append((0, 0, 0, none, "", 0))
                    continue
                base, all_ = spans(text)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((*counts, digest, written(all_), len(all_) - len(base)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint",
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The input rows with every span of the text replaced, overlapping ones once; other columns stay as they are,
    n_chars follows the text."""
    names = docs.columns
    at, plain = names.index("text"), [f"c{i}" for i in range(len(docs.columns))]  # names with dots are no names for Arrow functions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(_suspects(batch.column(at))):
                if text is None:
                    continue
                parts, done = [], 0
                for start, _, end in spans(text)[1]:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                texts[i] = "".join(parts) + text[done:] if parts else texts[i]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    ship(docs.sparkSession)
    renamed = docs.toDF(*plain)
    done = renamed.mapInArrow(run, renamed.schema).toDF(*names)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
