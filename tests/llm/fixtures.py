"""A small table of documents with the awkward cases, written as Parquet for the queries."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq


def prose(seed: int, n: int, line: int = 12) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    w = [rng.choice(vocabulary) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + line]).capitalize() + "." for i in range(0, n, line))


def edited(text: str, every: int, seed: int) -> str:
    rng = random.Random(seed)
    w = text.split(" ")
    for i in range(rng.randrange(every), len(w), every):
        w[i] = "other"
    return " ".join(w)


def texts() -> list[tuple[int | None, str | None]]:
    passage, menu = prose(1, 120), "Home | News | Sport | Weather\nClick here to read more\n"
    common = "This very line stands in many documents."
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one"), (5, "One  TWO\tthree"), (6, "\n\n\n"),
        (10, prose(2, 300)), (11, prose(2, 300)), (12, edited(prose(2, 300), 150, 1)),
        (13, prose(3, 200) + "\n" + passage), (14, passage + "\n" + prose(4, 150)), (15, prose(5, 90) + "\n" + passage + "\n" + passage),
        (16, f"{common}\n{prose(6, 60)}\n{common}"), (17, f"  {common.upper()} \r\n{prose(7, 60)}"), (18, f"{prose(8, 50)}\n\t{common}"),
        (19, menu * 4 + prose(9, 20)), (20, menu + prose(10, 200)), (21, "!!! ### $$$ &&& *** ???\n" * 6),
        (22, "the same five words again " * 30), (23, "Éa ÉA été ÀÇ naïve — «mot» \u00a0 \u2028 x" * 8 + "\n" + prose(11, 40)), (24, "x" * 5000), (25, "x" * 5000 + "y"),
        (26, prose(12, 60_000)), (27, "<|endoftext|> and <|startoftext|> are text, A.B,C.. d.,\r\n" + prose(13, 30)),
        (28, "abc" * 300), (29, "日本語のテキスト、句読点。" * 60), (30, prose(14, 34)), (31, prose(14, 35)), (32, prose(15, 35)), (33, prose(15, 35)),
        (40, prose(16, 80)), (40, prose(16, 80)), (40, prose(17, 80)), (None, prose(18, 80)), (None, prose(18, 80)), (None, None), (-7, f"{common}\nshort\nshort"),
    ]
    return out


def write(folder: str, rows: list[tuple], items: list[tuple] = (), labels: list[tuple] = (), urls: list[tuple] = ()) -> str:
    """Tables with extra columns whose names clash with those that the operators use inside."""
    clash = {c: pa.array([f"{c}{i}" for i in range(len(rows))], pa.string()) for c in ("_id", "_tag", "row", "body", "key", "lines", "words", "pos", "hits", "fp", "root", "score", "held_out", "marks", "queue", "task", "cleaned", "first")}
    docs = {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()),
        "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array([None if i % 5 == 0 else "en" for i in range(len(rows))], pa.string()),
        "source": pa.array([None if i % 7 == 0 else f"s{i % 3}" for i in range(len(rows))], pa.string()),
        "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64()),
    }
    pq.write_table(pa.table(docs | clash), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([r[0] for r in items], pa.int64()), "text": pa.array([r[1] for r in items], pa.string()), "hits": pa.array(["h"] * len(items), pa.string())}), f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([r[1] for r in labels], pa.int32()), "toxic": pa.array([r[2] for r in labels], pa.int32()), "text": pa.array(["t"] * len(labels), pa.string())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in urls], pa.int64()), "url": pa.array([r[1] for r in urls], pa.string()), "html": pa.array([""] * len(urls), pa.string()), "host": pa.array(["h"] * len(urls), pa.string())}), f"{folder}/pages.parquet")
    return folder
