"""The registered queries of the training-data operators, and their SQL."""

from .bpe import op11_bpe
from .centroids import OP12_SQL, op12_centroids
from .decontaminate import OP2_SQL, op2_decontaminate
from .fingerprint import op1_fingerprint
from .langid import op7_langid
from .lm import op3_lm
from .neardup import OP6_SQL, op6_neardup
from .packing import op9_packing
from .pii import op10_pii
from .preference import OP4_SQL, op4_preference
from .tokenfile import op5_token_shards
from .trie import OP13_SQL, op13_trie
from .urlfilter import OP8_SQL, op8_urlfilter

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_decontaminate": op2_decontaminate,
    "op3_lm": op3_lm,
    "op4_preference": op4_preference,
    "op5_token_shards": op5_token_shards,
    "op6_neardup": op6_neardup,
    "op7_langid": op7_langid,
    "op8_urlfilter": op8_urlfilter,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_bpe": op11_bpe,
    "op12_centroids": op12_centroids,
    "op13_trie": op13_trie,
}

ORACLES: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op4_preference": OP4_SQL, "op6_neardup": OP6_SQL, "op8_urlfilter": OP8_SQL, "op12_centroids": OP12_SQL, "op13_trie": OP13_SQL}
