"""Column expressions for months, labels, keys and node attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of the labels, January first.
MONTH_NAMES = [
    "janeiro", "fevereiro", "março", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
]

# Sentiment bands in order, with their colours (rgb and hex).
BANDS = [
    ("very negative", "rgb(204, 0, 0)", "#CC0000"),
    ("negative", "rgb(239, 83, 80)", "#EF5350"),
    ("neutral", "rgb(204, 204, 204)", "#CCCCCC"),
    ("positive", "rgb(102, 187, 106)", "#66BB6A"),
    ("very positive", "rgb(0, 200, 81)", "#00C851"),
]

# Caption of a graph node.
CAPTION_TOPIC = "Tópico: "
CAPTION_MENTIONS = "<br>Menções: "
CAPTION_LAST = "<br>Último registo: "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(yyyymm) -> Column:
    """``YYYYMM`` integer -> first day of that month (null when it has not six digits or no such month)."""
    c = _col(yyyymm)
    ts = F.try_to_timestamp(F.when(c.between(100000, 999999), c.cast("string")), F.lit("yyyyMM"))
    return ts.cast("date")


def month_tick(date) -> Column:
    """Axis tick ``YYYY-MM`` of a month start."""
    return F.date_format(_col(date), "yyyy-MM")


def _names(names=MONTH_NAMES) -> Column:
    return F.array(*[F.lit(n) for n in names])


def month_label(date, names=MONTH_NAMES) -> Column:
    """``<month name> de YYYY`` of a date; ``names`` are the twelve month names."""
    d = _col(date)
    return F.concat(F.element_at(_names(names), F.month(d)), F.lit(" de "), F.year(d).cast("string"))


def yyyymm_label(yyyymm, names=MONTH_NAMES) -> Column:
    """Same label straight from a ``YYYYMM`` integer; null when it has no such month."""
    c = _col(yyyymm)
    return F.concat(F.get(_names(names), (c % 100).cast("int") - 1), F.lit(" de "), (c / 100).cast("int").cast("string"))


def numbered_list(arr, sep: str = "<br>") -> Column:
    """``1. a<sep>2. b...``; ``-`` when the list is null."""
    items = F.transform(_col(arr), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.coalesce(F.array_join(items, sep), F.lit("-"))


def wrap_label(keyword, sep: str = "<br>") -> Column:
    """Multi-word keyword broken in two lines at its middle word."""
    k = _col(keyword)
    words = F.split(k, " ")
    mid = (F.size(words) / 2).cast("int")
    head = F.array_join(F.slice(words, F.lit(1), mid), " ")
    tail = F.array_join(F.slice(words, mid + 1, F.size(words) - mid), " ")
    return F.when(k.contains(" "), F.concat(head, F.lit(sep), tail)).otherwise(k)


def node_caption(keyword, count, last_seen) -> Column:
    return F.concat(
        F.lit(CAPTION_TOPIC), _col(keyword),
        F.lit(CAPTION_MENTIONS), _col(count).cast("string"),
        F.lit(CAPTION_LAST), _col(last_seen),
    )


def topic_key(topic) -> Column:
    """First 10 hex digits of the SHA-256 of the topic."""
    return F.substring(F.sha2(_col(topic), 256), 1, 10)


def tone_gauge(sentiment) -> Column:
    """Tone in [-1, 1] as a 0..100 gauge."""
    return (_col(sentiment) + F.lit(1.0)) / F.lit(2.0) * F.lit(100.0)


def sentiment_band(sentiment, q10, q30, q70, q90) -> Column:
    """Five bands: <= q10, <= q30, < q70, < q90, rest. Null tone or thresholds -> null."""
    s = _col(sentiment)
    names = [b[0] for b in BANDS]
    banded = (
        F.when(s <= _col(q10), names[0])
        .when(s <= _col(q30), names[1])
        .when(s < _col(q70), names[2])
        .when(s < _col(q90), names[3])
        .otherwise(names[4])
    )
    return F.when(s.isNull() | _col(q10).isNull(), F.lit(None).cast("string")).otherwise(banded)


def band_color(band) -> Column:
    """Hex colour of a band (a 5-entry literal map, no join)."""
    entries = []
    for name, _rgb, hexcode in BANDS:
        entries += [F.lit(name), F.lit(hexcode)]
    return F.try_element_at(F.create_map(*entries), _col(band))
