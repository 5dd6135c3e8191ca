"""Shared session and small meetings."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from groundledger.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = "struct<w:string,start_ms:bigint,end_ms:bigint,conf:double,disputed:boolean,alt:string>"
SEGMENT = f"meeting_id long, ord long, seg_id string, start_ms long, end_ms long, speaker string, text string, words array<{WORD}>"


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", 4)


def spoken(meeting_id, at, who, said, unsure=()):
    """Row of the line at position ``at``: lines begin every 20 s, words every 300 ms; words in ``unsure`` are disputed."""
    begin = 20_000 * at
    heard = [(w, begin + 300 * k, begin + 300 * k + 250, 0.9, w.strip(".,?!") in unsure, None) for k, w in enumerate(said.split())]
    return meeting_id, at + 1, f"S{at + 1:03d}", begin, heard[-1][2] if heard else begin, who, said, heard


@pytest.fixture(scope="session")
def meeting(spark):
    """Builds lines from ``{meeting: [(speaker, text[, unsure words])]}``."""
    def build(meetings):
        return spark.createDataFrame([spoken(m, at, *said) for m, lines in meetings.items() for at, said in enumerate(lines)], SEGMENT)

    return build


#: An introduction, misheard terms, numbers, an open idea, a decision with its answer, and two tasks.
PRINT_SHOP = [
    ("Speaker 1", "Good morning, my name is Helena and I run the print shop."),
    ("Speaker 3", "The jason export can't go out before the get hub checks are green."),
    ("Speaker 3", "Orders in the queue grew from twelve to ninety."),
    ("Speaker 2", "Perhaps we could keep the invoices in SQLite."),
    ("Speaker 1", "Then it is decided, batch 4 goes out without gold foil."),
    ("Speaker 3", "Sounds good."),
    ("Speaker 1", "I'll call the paper supplier on Tuesday... no, Thursday."),
    ("Speaker 3", "Someone has to label the spare plates."),
]
