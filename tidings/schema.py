"""Table schemas shared by the operators."""

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()

#: The normalized item, in stored order.
ITEM = T.StructType([
    T.StructField("id", _S),
    T.StructField("source", _S),
    T.StructField("source_label", _S),
    T.StructField("title", _S),
    T.StructField("url", _S),
    T.StructField("published", _S),
    T.StructField("first_seen", _S),
    T.StructField("summary", _S),
    T.StructField("category", _S),
    T.StructField("tags", T.ArrayType(_S)),
])
ITEM_COLUMNS = ITEM.fieldNames()

#: Insertion order of an item inside its store. `batch` numbers the run that inserted it and
#: `origin` / `pos` say where it stood in that run's input, so that (batch, origin, pos) is a total
#: order that never has to be renumbered by a global sort.
ORDER = T.StructType([
    T.StructField("batch", _L),
    T.StructField("origin", _S),
    T.StructField("pos", _L),
])
ORDER_COLUMNS = ORDER.fieldNames()

STORED_ITEM = T.StructType(ITEM.fields + ORDER.fields)

#: An item of a batch that has not been numbered yet.
FRESH_ITEM = T.StructType([f for f in STORED_ITEM.fields if f.name != "batch"])

LEDGER = T.StructType([T.StructField("id", _S), T.StructField("first_seen", _S)])

ARCHIVED_ITEM = T.StructType(STORED_ITEM.fields + [T.StructField("month", _S)])

#: An archived item as its file holds it, with a digest of its content and the version of its month;
#: and a month of a finished version (`at`: milliseconds since 1970).
VERSIONED_ITEM = T.StructType(STORED_ITEM.fields + [
    T.StructField("digest", _L), T.StructField("version", _L), T.StructField("month", _S)])
COMMIT = T.StructType([
    T.StructField("version", _L), T.StructField("month", _S), T.StructField("count", _L),
    T.StructField("at", _L)])

#: What tells whether an item is archived already: a narrow part of the archive's columns.
ARCHIVE_INDEX = T.StructType([
    T.StructField("month", _S), T.StructField("id", _S), T.StructField("digest", _L),
    *ORDER.fields])

MANIFEST = T.StructType([T.StructField("month", _S), T.StructField("count", _L)])

PAGE = T.StructType([T.StructField("url", _S), T.StructField("html", _S)])

#: RSS <item>, as far as it is used.
RSS_ENTRY = T.StructType([
    T.StructField("title", _S),
    T.StructField("link", _S),
    T.StructField("description", _S),
    T.StructField("pubDate", _S),
    T.StructField("guid", T.StructType([
        T.StructField("_VALUE", _S), T.StructField("_isPermaLink", _S)])),
    T.StructField("content:encoded", _S),
    T.StructField("dc:date", _S),
    T.StructField("category", T.ArrayType(_S)),
    T.StructField("_corrupt", _S),
])

#: Atom <entry>, as far as it is used. A text construct is read as a string: escaped markup unescaped, and
#: of a subtree (xhtml) its inner markup.
ATOM_ENTRY = T.StructType([
    T.StructField("title", _S),
    T.StructField("updated", _S),
    T.StructField("published", _S),
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_href", _S), T.StructField("_rel", _S),
    ]))),
    T.StructField("summary", _S),
    T.StructField("content", _S),
    T.StructField("_corrupt", _S),
])

REPO_LISTING = T.StructType([
    T.StructField("full_name", _S),
    T.StructField("archived", T.BooleanType()),
    T.StructField("fork", T.BooleanType()),
    T.StructField("_corrupt", _S),
])

RUN = T.StructType([
    T.StructField("batch", _L),
    T.StructField("as_of", _S),
    T.StructField("live_path", _S),
    T.StructField("fetched", T.MapType(_S, _L)),
    T.StructField("live", _L),
    T.StructField("net_new", _L),
    T.StructField("outside_window", _L),
    T.StructField("newly_archived", _L),
    T.StructField("stream", _S),
    T.StructField("stream_batch", _L),
])
