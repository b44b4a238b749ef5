"""One fixed schema per relation."""

from __future__ import annotations

PLAYLIST_SONG = "playlist_id string, song_id string"
PLAYLIST_INFO = "glid string, listname string, nickname string, tag_list string, feat string, collect_type string, play_count string, description string, creator string, tags string"
SONG_INFO = "song_id string, name string, singer string"
SONG_VECTORS = "song_id string, v array<double>"
SEMANTIC_IDS = "song_id string, semantic_ids array<int>"
CORPUS = "glid string, input_text string, output_sequence string"
RANKING_PAIRS = "text string, song_id string, label int"
QUERY_VOTE = "query string, song_infos string, search_pv string, cnt string"
