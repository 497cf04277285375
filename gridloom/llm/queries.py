"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP4_SQL, op4_chat
from .infill import OP11_SQL, op11_infill
from .lines import op8_lines
from .media import op1_media
from .packing import op2_packing
from .pieces import op3_sentencepiece
from .quality import op5_quality
from .shingles import op7_ngrams
from .sketches import op9_fingerprints
from .spans import op10_substrings
from .substrings import op6_suffixes
from .trie import OP13_SQL, op13_trie
from .windows import op12_windows

QUERIES = {
    "op1_media": op1_media,
    "op2_packing": op2_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_suffixes": op6_suffixes,
    "op7_ngrams": op7_ngrams,
    "op8_lines": op8_lines,
    "op9_fingerprints": op9_fingerprints,
    "op10_substrings": op10_substrings,
    "op11_infill": op11_infill,
    "op12_windows": op12_windows,
    "op13_trie": op13_trie,
}
SQL = {"op4_chat": OP4_SQL, "op11_infill": OP11_SQL, "op13_trie": OP13_SQL}
