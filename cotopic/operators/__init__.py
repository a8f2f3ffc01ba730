"""Lazy DataFrame -> DataFrame operators; each output carries a ``topic`` column."""

from cotopic.operators.articles import (  # noqa: F401
    OUTLETS, match_outlet, newest_articles, ordered_articles, outlet_of, relation_articles,
)
from cotopic.operators.history import (  # noqa: F401
    fill_months, history_peak, month_spine, monthly_articles, monthly_mentions,
    monthly_top_keywords, ordered_history, relation_history, topic_history,
)
from cotopic.operators.nodes import (  # noqa: F401
    relation_nodes, relation_years, sentiment_quantiles, sentiment_thresholds, top_relations,
)
from cotopic.operators.relations import (  # noqa: F401
    keyword_weights, neighbours, recommend, relation_exists, relation_extremes, relation_months,
    relation_sources,
    relation_summary, relations, relations_nested,
)
from cotopic.operators.topics import (  # noqa: F401
    corpus_summary, mention_rows, mentions, topic_hits, topic_sources, topic_summary,
)
