"""Quality rules: lines are judged first, then the document by what its lines have lost."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowlens.llm.common import leave_nothing_kept

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
UPPER, LOWER = r"\p{Lu}", r"\p{Ll}"
#: Words that part the entries of a menu or a breadcrumb trail.
SEPARATORS = ("|", "/", "»", "›", "•", "·", ">", "::")
#: What a sentence ends with, with closing quotes or brackets behind it.
SENTENCE_END = r"[.!?…:;。！？؟।][\"'”“’‘»«)\]]*$"
#: Phrases of notices and controls, looked for in lower case.
BOILERPLATE = (
    r"all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy"
    r"|use of cookies|uses cookies|enable javascript|sign (in|up)|log ?in|subscribe to|click here|read more"
    r"|share this|powered by|copyright (©|\(c\)|[0-9]{4})|skip to (main )?content|back to top"
)
_words, _symbols = regex.compile(WORD).findall, regex.compile(SYMBOL).findall
_ends, _notice = regex.compile(SENTENCE_END).search, regex.compile(BOILERPLATE).search
_upper, _lower = regex.compile(UPPER).findall, regex.compile(LOWER).findall


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules. Shares are in percent."""

    min_words: int = 10
    max_repeat_words: int = 20
    window: int = 5
    symbol_share: int = 10
    menu_entry: int = 5
    shout_letters: int = 10
    unended_words: int = 8
    notice_words: int = 25
    max_lost: int = 50

    def line_fails(self, line: str, words: list[str], n_chars: int) -> bool:
        """Whether a line with words is symbols, a menu, shouting, an unended scrap or a notice."""
        if len(_symbols(line)) * 100 > self.symbol_share * n_chars:
            return True
        separators = sum(map(words.count, SEPARATORS))
        if separators >= 2 and len(words) <= self.menu_entry * separators:
            return True
        if len(words) < self.unended_words and not _ends(words[-1]):
            return True
        if len(words) <= self.notice_words and _notice(line.lower()):
            return True
        upper = len(_upper(line))
        return upper >= self.shout_letters and upper > len(_lower(line))

    def judged(self, text: str) -> tuple:
        """Counts, verdicts and the lines that stay, of one text."""
        n_words = word_chars = lost = n_removed = n_dup_lines = 0
        words, stay, seen = [], [], set()
        for line in text.split("\n"):
            found = _words(line)
            if not found:
                stay.append(line)
                continue
            n_dup_lines += line in seen
            seen.add(line)
            n_chars = sum(map(len, found))
            word_chars += n_chars
            words += found
            if self.line_fails(line, found, n_chars):
                lost += n_chars
                n_removed += 1
            else:
                stay.append(line)
        n_words = len(words)
        n_repeat_words = repeated_words(words, self.window)
        base_failed = n_words < self.min_words or 100 * n_repeat_words > self.max_repeat_words * n_words
        kept = not base_failed and 100 * lost <= self.max_lost * word_chars
        n_symbols = len(_symbols(text))
        return (
            n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed, lost, "\n".join(stay)
        )


def repeated_words(words: list[str], window: int) -> int:
    """How many words lie in windows of ``window`` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*[words[i:] for i in range(window)]))
    if len(set(windows)) == n:
        return 0
    times, covered, total = Counter(windows), 0, 0  # covered: words before this position are counted
    for begin, found in enumerate(windows):
        if times[found] > 1:
            total += begin + window - max(begin, covered)
            covered = begin + window
    return total


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_removed_lines bigint, removed_chars bigint"
)


def clean_lines(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """Judge every whole text of ``docs`` (doc_id, text) line by line and then as a document.

    A line with words is removed when it is mostly symbols, parts a few words by menu separators,
    is short and ends no sentence, is a notice of known wording, or is written in capitals. A
    document fails when it is too short, repeats itself, or loses over ``max_lost`` percent of its
    word characters with its lines. ``with_text`` adds ``text``: the lines that stay.

    One row per row of ``docs``, without a shuffle. A null or empty text has no words and fails; a
    null doc_id stays null; repeated rows are judged each; other columns play no part. A text is
    judged whole, however long; one text at a time is in a worker's memory as words.
    """
    names = ("doc_id", *(f.split()[0] for f in SCHEMA.split(", ")[1:]), *(("text",) if with_text else ()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_nothing_kept()
        for batch in batches:
            rows = [rules.judged(text.as_py() or "") for text in batch.column("text")]
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            arrays = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            if with_text:
                arrays.append(pa.array(columns[9], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    source = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return source.mapInArrow(judge, SCHEMA + (", text string" if with_text else ""))


def line_rules_sql(rules: Rules = Rules()) -> str:
    """The same counts and verdicts of ``documents`` in DuckDB's SQL."""
    separators = ", ".join(f"'{s}'" for s in SEPARATORS)
    end, notice = SENTENCE_END.replace("'", "''"), BOILERPLATE.replace("'", "''")

    def count(text: str, pattern: str) -> str:
        return f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"

    w = rules.window
    window = "[" + ", ".join(f"lead(w, {i}) OVER (PARTITION BY r ORDER BY p)" for i in range(w)) + "]"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS MATERIALIZED (
  SELECT r, n, line, regexp_extract_all(line, '{WORD}') AS words
  FROM (SELECT r, unnest(str_split(text, chr(10))) AS line, unnest(range(len(str_split(text, chr(10))))) AS n FROM d)),
full_lines AS MATERIALIZED (
  SELECT r, n, line, words, len(words) AS n_words, CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS chars,
    row_number() OVER (PARTITION BY r, line ORDER BY n) > 1 AS dup
  FROM lines WHERE len(words) > 0),
judged AS (
  SELECT *, 100 * ({count('line', SYMBOL)}) > {rules.symbol_share} * chars
    OR (len(list_filter(words, lambda x: x IN ({separators}))) >= 2
      AND n_words <= {rules.menu_entry} * len(list_filter(words, lambda x: x IN ({separators}))))
    OR (n_words < {rules.unended_words} AND NOT regexp_matches(words[-1], '{end}'))
    OR (n_words <= {rules.notice_words} AND regexp_matches(lower(line), '{notice}'))
    OR ({count('line', UPPER)} >= {rules.shout_letters} AND {count('line', UPPER)} > {count('line', LOWER)}) AS fails
  FROM full_lines),
per_line AS (
  SELECT r, sum(n_words) AS n_words, sum(chars) AS word_chars, count(*) FILTER (dup) AS n_dup_lines,
    coalesce(sum(chars) FILTER (fails), 0) AS removed_chars, count(*) FILTER (fails) AS n_removed_lines
  FROM judged GROUP BY r),
words AS MATERIALIZED (
  SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM (
    SELECT r, regexp_extract_all(text, '{WORD}') AS words FROM d)),
windows AS MATERIALIZED (SELECT r, p, {window} AS found, lead(w, {w - 1}) OVER (PARTITION BY r ORDER BY p) IS NOT NULL AS whole FROM words),
twice AS (SELECT r, found FROM windows WHERE whole GROUP BY r, found HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT windows.r, unnest(range(p, p + {w})) AS p FROM windows JOIN twice
      ON windows.r = twice.r AND windows.found = twice.found WHERE whole) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    {count('text', SYMBOL)} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
    CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars
  FROM d LEFT JOIN per_line USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words} * n_words)
    AND 100 * removed_chars <= {rules.max_lost} * word_chars AS kept
FROM counts"""
