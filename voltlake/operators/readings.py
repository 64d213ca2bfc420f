"""Cell readings through an injected reader, so that any recogniser or a table of fixed answers can stand behind the column classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Reader = Callable[[bytes, str, int, str], str]


def read(cells: DataFrame, reader: Reader, modes: list[tuple[str, str, int]]) -> DataFrame:
    """(doc_id, row, col, mode, lang, text, error): each cell (doc_id, row, col, image) read in every mode (language, allowed characters, page
    mode). A reader's failure is an empty text with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                for mode, (lang, allow, page) in enumerate(modes):
                    try:
                        text, error = reader(bytes(r.image) if r.image is not None else b"", allow, page, lang) or "", None
                    except Exception as e:  # one unreadable cell must not stop the sheet; the error is data
                        text, error = "", f"{type(e).__name__}: {e}"
                    rows.append((r.doc_id, r.row, r.col, mode, lang, text, error))
            yield pd.DataFrame(rows, columns=["doc_id", "row", "col", "mode", "lang", "text", "error"])

    return cells.select("doc_id", "row", "col", "image").mapInPandas(run, "doc_id string, row int, col int, mode int, lang string, text string, error string")
