"""Listings of courses, line by line, as a table function: a machine that walks each document's lines in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TERMS, CREDITS = r"^([0-9]{2}\.[0-9]{3})\s+(.+)$", r"(?i)^terms?:?\s*(.+)$", r"(?i)^credits?:?\s*([0-9]+)"
RECORD = "code string, title string, course_type string, terms string, credits int"


def _machine(doc: str, line: str, head: str, kind: str):
    """The table function: one walk for each document, with one open record at a time."""

    class Walk:
        def __init__(self) -> None:
            self.record: list | None = None
            self.before: str | None = None
            self.head, self.terms, self.credits = re.compile(head), re.compile(TERMS), re.compile(CREDITS)

        def eval(self, row) -> Iterator[tuple]:
            said = row[line]
            if said is None:
                self.before = None
                return
            opened = self.head.match(said)
            if opened:
                if self.record:
                    yield tuple(self.record)
                self.record = [row[doc], opened.group(1), opened.group(2), self.before, None, None]
            elif self.record:
                for place, found in ((4, self.terms.match(said)), (5, self.credits.match(said))):
                    if found and self.record[place] is None:
                        self.record[place] = found.group(1) if place == 4 else int(found.group(1))
            self.before = said

        def terminate(self) -> Iterator[tuple]:
            if self.record:
                yield tuple(self.record)

    return F.udtf(Walk, returnType=f"`{doc}` {kind}, {RECORD}")


def course_records(lines: DataFrame, doc: str, no: str, line: str, head: str = HEAD) -> DataFrame:
    """(doc, code, title, course_type, terms, credits): what ``readers.course_blocks`` finds, in one walk over
    each document's lines in the order of ``no``.  A line that fits ``head`` opens a record and ends the one
    before; the line before it is the course type; of several terms or credits the first counts.  A document
    is one partition of the function and never split; it holds a record at a time, whatever its length."""
    kind = lines.schema[doc].dataType.simpleString()
    return _machine(doc, line, head, kind)(lines.select(doc, no, line).asTable().partitionBy(doc).orderBy(no))
