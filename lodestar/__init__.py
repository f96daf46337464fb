"""lodestar: player analytics and recommendations on Spark.

The operators of the inventory, by group (see README for the query names):

- sources: read_table, read_raw, read_store, write_store, append_sessions, write_dataset
- validate: collect_valid, collect_rejected, admit, require_truthy_id, apply_history_defaults,
  clean, resolve_ids, upsert_players
- filters / joins: recent_sessions, recent_recs, recently_played, lookup, sessions_with_games,
  merge_tables, build_dataset, exclude_owned, left_join
- aggregates: player_stats, player_stats_one, aggression, genre_preference, daily_quality,
  genre_stats, total_play_time, genre_counts, type_counts, describe, exact_quantiles,
  list_players, interactions
- ranking / profiles: top_genres, top_n, leave_last_out, build_profiles, recommend_titles,
  add_players, add_players_to_store, get_recommendations
- features / monitoring / post-processing: behavioral_features, normalize, temporal_features,
  update_feature_store, read_feature_store, log_quality, alerts, apply_business_rules,
  diversify, explain
- models / metrics: tfidf, user_vectors, content_recommend, cold_start, als, als_recommend,
  neural_fit, neural_rerank, propagate, graph_recommend, blend, dense_top_n, precision_at,
  hit_rate, ndcg, evaluate, compare, compare_paired
- streaming: stream_ingest, stream_daily_quality, sessionize, revise_sessions_stream,
  upsert_players_stream, upsert_documents_stream; stores: revise_sessions, read_sessions
"""

from lodestar.functions.scalar import (  # noqa: F401
    compact,
    day_of,
    genre_title,
    percent_of,
    preferred_type,
    seconds_between,
    skill_level,
    skill_title,
    stamp,
    type_title,
)
from lodestar.operators.aggregates import (  # noqa: F401
    aggression,
    daily_quality,
    describe,
    exact_quantiles,
    genre_counts,
    genre_preference,
    genre_stats,
    interactions,
    list_players,
    player_stats,
    player_stats_one,
    total_play_time,
    type_counts,
)
from lodestar.operators.content import cold_start, content_recommend, tfidf, user_vectors  # noqa: F401
from lodestar.operators.evaluate import compare, compare_paired, evaluate, hit_rate, ndcg, precision_at  # noqa: F401
from lodestar.operators.features import (  # noqa: F401
    behavioral_features,
    normalize,
    read_feature_store,
    temporal_features,
    update_feature_store,
)
from lodestar.operators.filters import lookup, recent_recs, recent_sessions, recently_played  # noqa: F401
from lodestar.operators.joins import (  # noqa: F401
    build_dataset,
    exclude_owned,
    left_join,
    merge_tables,
    sessions_with_games,
)
from lodestar.operators.models import (  # noqa: F401
    als,
    als_recommend,
    blend,
    graph_recommend,
    neural_fit,
    neural_rerank,
    propagate,
)
from lodestar.operators.monitor import alerts, log_quality  # noqa: F401
from lodestar.operators.postprocess import apply_business_rules, diversify, explain  # noqa: F401
from lodestar.operators.profile import (  # noqa: F401
    add_players,
    add_players_to_store,
    build_profiles,
    get_recommendations,
    recommend_titles,
)
from lodestar.operators.ranking import leave_last_out, top_genres, top_n  # noqa: F401
from lodestar.operators.scoring import dense_top_n  # noqa: F401
from lodestar.operators.sparse import sparse_top_n  # noqa: F401
from lodestar.operators.validate import (  # noqa: F401
    admit,
    apply_history_defaults,
    clean,
    collect_rejected,
    collect_valid,
    require_truthy_id,
    resolve_ids,
    upsert_players,
)
from lodestar.sources.tables import (  # noqa: F401
    append_sessions,
    read_raw,
    read_store,
    read_table,
    write_dataset,
    write_store,
)
from lodestar.sources.session_store import read_sessions, revise_sessions  # noqa: F401
from lodestar.streaming.keyed import upsert_players_stream  # noqa: F401
from lodestar.streaming.streams import (  # noqa: F401
    revise_sessions_stream,
    sessionize,
    stream_daily_quality,
    stream_ingest,
    upsert_documents_stream,
)
