"""Commands that have no analytic result, and how this library stands to each: what is not built is listed."""

#: Commands of a server, its connections and its replicas. A library of plans has none of these.
OUT_OF_SCOPE = (
    "ACL ASKING AUTH BGREWRITEAOF CLIENT CLUSTER COMMAND CONFIG DEBUG FAILOVER HELLO LATENCY LOLWUT MIGRATE MODULE MONITOR PING PSYNC QUIT "
    "READONLY READWRITE REPLCONF REPLICAOF RESET RESTORE-ASKING ROLE SELECT SHUTDOWN SLAVEOF SLOWLOG SWAPDB MOVE SYNC WAIT WAITAOF XGPU"
).split()
#: Commands that need a language model or an embedder: pass a function to ``keyloom.functions.scripts.register``.
HOOKS = "AI.CHAT AI.COMPLETE AI.FLARE AI.EMBED AI.GENERATE AI.LOADMODEL".split()
#: Refused on purpose.
REFUSED = {"VLINKS": "there is no graph to show", "SORT BY": "patterns and GET", "VSIM FILTER": "filter the rows first", "FT.SEARCH OR": "alternatives and negation"}
#: Surveyed, but not built.
NOT_BUILT = {
    "TIME": "the clock of the session, no rows", "SAVE, BGSAVE, LASTSAVE, KV.PREFIX.SAVE, KV.PREFIX.COMMIT": "sources.tables.commit, versions and last_save, without queries",
    "LAYER.STORE, LAYER.FETCH, LAYER.BATCH, LAYER.EXTEND": "framed commands of a binary connection", "INFO": "of a server; info_keyspace has the keys",
    "VSIM over a graph": "ann_search is an inverted file", "delta merge": "an index is a view, so there is nothing to merge",
}
