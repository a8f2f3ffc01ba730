"""Column -> Column functions (URL parts, labels, keys). All JVM-side expressions."""

from cotopic.functions.labels import (  # noqa: F401
    BANDS, MONTH_NAMES, band_color, month_label, month_start, month_tick, node_caption,
    numbered_list, sentiment_band, tone_gauge, topic_key, wrap_label, yyyymm_label,
)
from cotopic.functions.urls import (  # noqa: F401
    article_title, capture_date, capture_month, capture_order, capture_stamp, clean_title,
    original_url, outlet_host, url_segment, url_slug,
)
