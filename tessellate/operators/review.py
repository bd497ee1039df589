"""Review pages: highlighted text of one annotated document as self-contained HTML."""

from __future__ import annotations

import html
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..types import InvalidDatasetError
from .documents import slices

#: Background colours of classes, used in turn.
PALETTE = ("#cfe8fc", "#d5f5d3", "#fde8c8", "#f8d3da", "#e3d9f7", "#fff3b0", "#c9f0ee", "#ead7c5", "#dfe3e8", "#f5cdf0")


def valid(extractions: Column) -> Column:
    """Extractions with both ends of their place."""
    return F.filter(extractions, lambda e: e["char_interval"]["start_pos"].isNotNull() & e["char_interval"]["end_pos"].isNotNull())


def class_colors(rows: DataFrame) -> DataFrame:
    """``document_id, extraction_class, color_index`` over grounded classes, by name within a document."""
    classes = rows.filter(F.col("char_interval.start_pos").isNotNull() & F.col("char_interval.end_pos").isNotNull()).select("document_id", "extraction_class").distinct()
    rank = F.dense_rank().over(Window.partitionBy("document_id").orderBy("extraction_class"))
    return classes.withColumn("color_index", F.pmod(rank - 1, F.lit(len(PALETTE))))


def highlighted(text: str, spans: list[tuple[int, int, str]], colors: dict[str, str]) -> str:
    """Text with nested ``span`` elements for (start, end, class); everything else is escaped.

    Spans that cross are cut where an outer one ends, so the markup always nests.
    """
    points = [(s, 1, s - e, k) for k, (s, e, _) in enumerate(spans) if s < e] + [(e, 0, 0, k) for k, (s, e, _) in enumerate(spans) if s < e]
    out, at, open_ = [], 0, []
    for p, starts, _, k in sorted(points):
        out.append(html.escape(text[at:p]))
        at = p
        start = lambda i: f'<span class="hl" data-i="{i}" style="background:{colors[spans[i][2]]}">'
        if starts:
            open_.append(k)
            out.append(start(k))
        elif k in open_:
            cut = len(open_) - open_.index(k)
            again = open_[-cut + 1 :] if cut > 1 else []
            out.append("</span>" * cut)
            open_ = open_[: len(open_) - cut] + again
            out += [start(i) for i in again]
    return "".join(out) + html.escape(text[at:])


def page(text: str, extractions: list[dict], speed: float = 1.0, legend: bool = True, context: int = 150, compact: bool = False) -> str:
    """A page with the highlighted text, a legend, and a player over the extractions."""
    found = [e for e in extractions if (c := e.get("char_interval")) and c.get("start_pos") is not None and c.get("end_pos") is not None]
    found.sort(key=lambda e: (e["char_interval"]["start_pos"], e["char_interval"]["start_pos"] - e["char_interval"]["end_pos"]))
    colors = {c: PALETTE[k % len(PALETTE)] for k, c in enumerate(sorted({e["extraction_class"] for e in found}))}
    spans = [(e["char_interval"]["start_pos"], e["char_interval"]["end_pos"], e["extraction_class"]) for e in found]
    cards = []
    for e, (s, t, name) in zip(found, spans, strict=True):
        given = json.loads(e["attributes"]) if isinstance(e.get("attributes"), str) else e.get("attributes") or {}
        shown = {k: ", ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in given.items() if v not in (None, "", "null", [])}
        cards.append({"class": name, "text": e["extraction_text"], "attributes": shown, "before": text[max(0, s - context) : s], "after": text[t : t + context]})
    data = json.dumps(cards, ensure_ascii=False).replace("<", "\\u003c")  # nothing can close the script
    keys = "".join(f'<span style="background:{c}">{html.escape(n)}</span> ' for n, c in colors.items()) if legend else ""
    size = "font-size:13px" if compact else "font-size:16px"
    return (
        f'<!DOCTYPE html><meta charset="utf-8"><style>body{{font-family:sans-serif;{size}}}.on{{outline:2px solid #333}}pre{{white-space:pre-wrap}}</style>'
        f'<p>{keys}</p><p><button id="play">play</button> <input id="at" type="range" min="0" max="{max(len(cards) - 1, 0)}" value="0"> <span id="card"></span></p>'
        f"<pre>{highlighted(text, spans, colors)}</pre><script>const cards={data};const at=document.getElementById('at');"
        "function show(){const k=+at.value,c=cards[k];document.querySelectorAll('.hl').forEach(e=>e.classList.toggle('on',+e.dataset.i===k));"
        "if(c)document.getElementById('card').textContent=c['class']+': '+c.text+' '+JSON.stringify(c.attributes);}"
        f"let t=null;document.getElementById('play').onclick=()=>{{if(t){{clearInterval(t);t=null}}else t=setInterval(()=>{{at.value=(+at.value+1)%Math.max(cards.length,1);show()}},{1000 * speed:g})}};"
        "at.oninput=show;show()</script>"
    )


def visualized(annotated: DataFrame, **options) -> str:
    """The page of the document with the lowest id (the first one of a file: :func:`visualized_file`)."""
    return _shown(annotated.orderBy("document_id").limit(1).collect(), **options)


def visualized_file(spark: SparkSession, path: str, **options) -> str:
    """The page of the first document of a file of JSON lines."""
    from ..sources.documents import read_jsonl

    return _shown(read_jsonl(spark, path).limit(1).collect(), **options)


def _shown(rows: list, **options) -> str:
    if not rows:
        raise InvalidDatasetError("no documents to show")
    row = rows[0].asDict(recursive=True)
    if row["text"] is None or row["extractions"] is None:
        raise InvalidDatasetError("a document to show needs its text and extractions")
    if not any((e["char_interval"] or {}).get("end_pos") is not None for e in row["extractions"]):
        return '<!DOCTYPE html><meta charset="utf-8"><p>Nothing in this document is grounded, so there is nothing to show.</p>'
    return page(row["text"], row["extractions"], **options)


def page_column(text: Column, extractions: Column, **options) -> Column:
    """Pages of all documents, in Arrow batches."""

    @F.arrow_udf("string")
    def made(texts: pa.Array, found: pa.Array) -> pa.Array:
        made = []
        for first, own in slices(texts):  # rows, extractions and pages as Python objects of a slice at a time
            rows = zip(own.to_pylist(), found.slice(first, len(own)).to_pylist(), strict=True)
            made.append(pa.array([page(t or "", e or [], **options) for t, e in rows], pa.string()))
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    return made(text, extractions)
