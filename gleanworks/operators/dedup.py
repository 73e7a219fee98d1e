"""Order-dependent de-duplication of (image, text) samples.

A sample is dropped when one *earlier kept* sample matches both its image and its text (text alone decides when either side
has no usable image). "Kept" makes the rule sequential, and neither relation is transitive, so neither a distinct nor
connected components give this answer. The work is split into:

1. collapse rows with equal text and equal hash (only the first can survive);
2. give every remaining node blocking keys (context, text key). A context is a pair of near hashes, or the empty context for "somebody
   has no image"; sharing a key is necessary for a match;
3. peel large buckets: a node that comes first in all its buckets is kept for sure, and everything similar to it in those
   buckets is dropped. That needs one comparison per member, not one per pair, so a group of near copies that holds a
   third of all rows costs a linear number of comparisons;
4. list the edges inside the remaining small buckets, verify them, and resolve with ``graph.greedy_dropped``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..ordering import first_wins, rank_in_groups
from ..session import cut_lineage, one_row, spread
from . import graph, simjoin

PEEL_ABOVE = 512


def _nodes(samples: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """seq, tid, h, text. ``tid`` is the first ``seq`` with the same stripped text, so it identifies the text exactly.

    ``samples``: seq, text[, image_path]; ``hashes``: image_path, phash (one row per path).
    """
    s = samples.select("seq", F.coalesce(tx.strip(F.col("text")), F.lit("")).alias("text"),
                       *([F.col("image_path")] if hashes is not None else []))
    if hashes is not None:
        s = s.join(hashes.select("image_path", F.col("phash").alias("h")), "image_path", "left").drop("image_path")
    else:
        s = s.withColumn("h", F.lit(None).cast("long"))
    s = s.withColumn("key", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))
    ids = s.groupBy("key").agg(F.min("seq").alias("tid"))
    return s.join(ids, "key").select("seq", "tid", "h", "text")


def _any_context():
    none = F.lit(None).cast("long")
    return F.struct(none.alias("a"), none.alias("b"))


def _contexts(nodes: DataFrame, pairs: DataFrame, with_any: bool) -> DataFrame:
    """(seq, ctx, lone): contexts a node takes part in; ``lone`` marks a node without image. ``pairs``: near hashes (a, b)."""
    imgs = nodes.filter("h is not null").select("h").distinct()
    both = pairs.select(F.struct("a", "b").alias("ctx"), F.explode(F.array("a", "b")).alias("h"))
    own = imgs.select(F.struct(F.col("h").alias("a"), F.col("h").alias("b")).alias("ctx"), "h")
    ctx = nodes.select("seq", "tid", "h").join(both.unionByName(own), "h").select(
        "seq", "tid", "ctx", F.lit(False).alias("lone"), F.lit(False).alias("any"))
    if with_any:
        every = nodes.select("seq", "tid", _any_context().alias("ctx"), F.col("h").isNull().alias("lone"),
                             F.lit(True).alias("any"))
        ctx = ctx.unionByName(every)
    return ctx


def _leaders(post: DataFrame) -> DataFrame:
    per = post.groupBy("k").agg(F.min("seq").alias("first"), F.min(F.when(F.col("lone"), F.col("seq"))).alias("first_lone"))
    lead = F.when(F.col("any") & ~F.col("lone"), F.col("first_lone")).otherwise(F.col("first"))
    return post.join(per, "k").select("seq", lead.alias("lead"))


def _resolve(post: DataFrame, verify, peel_above: int = PEEL_ABOVE) -> DataFrame:
    """Dropped ``seq`` values. ``post``: seq, k, lone, any. ``verify(pairs a<b)`` keeps the true matches.

    Buckets above ``peel_above`` rows are peeled as long as that takes at least a twentieth of their rows at a time; what
    is left is compared pair by pair. Neither number changes the result.
    """
    post = cut_lineage(post)
    gone: list[DataFrame] = []
    while True:
        large = post.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > peel_above)
        before = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not before:
            break
        lead = cut_lineage(_leaders(post))
        blocked = F.max(F.coalesce(F.col("lead") < F.col("seq"), F.lit(False)))
        sure = cut_lineage(lead.groupBy("seq").agg(blocked.alias("blocked")).filter(~F.col("blocked")).select("seq"))
        star = lead.filter("lead < seq").select(F.col("lead").alias("a"), F.col("seq").alias("b"))
        star = star.join(sure, star.a == sure.seq, "left_semi")
        # a row with an image may be sure without leading its "any" bucket: there it meets all later rows without image
        held = post.filter("any and not lone").join(sure, "seq", "left_semi").select("k", F.col("seq").alias("a"))
        bare = post.filter("any and lone").select("k", F.col("seq").alias("b"))
        star = star.unionByName(held.join(bare, "k").filter("a < b").select("a", "b")).distinct()
        out = cut_lineage(verify(star).select(F.col("b").alias("seq")).distinct())
        gone.append(out)
        rows = post.count()
        post = cut_lineage(post.join(sure, "seq", "left_anti").join(out, "seq", "left_anti"))
        if rows - post.count() < before / 20:
            break
    x, y = post.filter("not any").alias("x"), post.filter("not any").alias("y")
    img = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.seq") < F.col("y.seq")))
    img = img.select(F.col("x.seq").alias("a"), F.col("y.seq").alias("b"))
    u, v = post.filter("any and lone").alias("x"), post.filter("any").alias("y")
    lone = u.join(v, (F.col("x.k") == F.col("y.k")) & (F.col("x.seq") != F.col("y.seq")))
    lone = lone.select(F.least("x.seq", "y.seq").alias("a"), F.greatest("x.seq", "y.seq").alias("b"))
    edges = verify(img.unionByName(lone).distinct())
    gone.append(graph.greedy_dropped(edges).select(F.col("node").alias("seq")))
    return reduce(DataFrame.unionByName, gone)


def _collapse(nodes: DataFrame) -> DataFrame:
    return first_wins(nodes, ["tid", "h"])


def dedup_exact(samples: DataFrame, hashes: DataFrame | None = None, img: int = 5) -> DataFrame:
    """(seq, kept, kind): kind is pair, text or NULL; equal stripped text, and images closer than ``img`` bits."""
    nodes = cut_lineage(_nodes(samples, hashes).drop("text"))
    first = cut_lineage(_collapse(nodes))
    ctx = _contexts(first, simjoin.hamming_pairs(first.select("h"), None, img - 1), True) if hashes is not None else None
    if ctx is None:  # text alone: the collapsed rows are the answer
        gone = first.select("seq").limit(0)
    else:
        post = ctx.select("seq", F.struct("ctx", F.col("tid").alias("key")).alias("k"), "lone", "any")
        gone = _resolve(post, lambda pairs: pairs)
    kept = cut_lineage(first.join(gone, "seq", "left_anti").select("seq", "tid", "h"))
    # the first kept row that matches decides the label, as a scan in input order would
    no_img = kept.groupBy("tid").agg(F.min("seq").alias("first_any"),
                                             F.min(F.when(F.col("h").isNull(), F.col("seq"))).alias("first_lone"))
    out = nodes.join(no_img, "tid").join(kept.select("seq", F.lit(True).alias("kept")), "seq", "left")
    by_text = F.when(F.col("h").isNull(), F.col("first_any") < F.col("seq")).otherwise(
        F.coalesce(F.col("first_lone") < F.col("seq"), F.lit(False)))
    return out.select("seq", F.coalesce("kept", F.lit(False)).alias("kept"),
                      F.when(F.col("kept").isNull(), F.when(by_text, F.lit("text")).otherwise(F.lit("pair"))).alias("kind"),
                      F.col("h").isNotNull().alias("has_image"))


def dedup_near(samples: DataFrame, hashes: DataFrame | None = None, img: int = 5, text: float = 0.85, n: int = 2,
               keep_same_image: bool = True, peel_above: int = PEEL_ABOVE, similar: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(seq, kept, note): note is dup_pair, dup_image, same_image_diff_text, dup_text or NULL. ``peel_above`` never changes the result.

    ``similar`` replaces the n-gram similarity of texts: it gets (tid, text), distinct non-empty texts, and returns the similar
    pairs (a, b) of tids, such as a vector search gives; equal texts need not be among them.
    """
    nodes = cut_lineage(_nodes(samples, hashes).withColumn("real", F.length("text") > 0).drop("text"))
    first = cut_lineage(_collapse(nodes))
    ids = nodes.filter("seq = tid and real").select("tid")
    texts = samples.select(F.col("seq").alias("tid"), tx.strip(F.col("text")).alias("text")).join(ids, "tid", "left_semi")  # read where it is used: texts are stored by what compares them
    found = sigs = None
    if similar is not None:
        texts = spread(cut_lineage(texts))
        found = similar(texts)
    elif hashes is not None:  # the notes need all similar pairs anyway
        found = simjoin.near_pairs(texts, n, text)
    else:
        with simjoin.sized_texts(texts, n, text) as sized:
            pairs, hot = simjoin.near_candidates(sized, n, text, peel_above)
            found = cut_lineage(simjoin.similar_of(pairs, sized, n, text))
        if not hot.isEmpty():  # groups that need peeling: their pairs are not listed
            sigs = hot.select("tid", F.col("lead").alias("key")).unionByName(found.select(F.explode(F.array("a", "b")).alias("tid"), F.xxhash64("a", "b").alias("key")))
            found, texts = None, spread(cut_lineage(texts))
    if found is not None:
        found = found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = cut_lineage(found)
        sigs = found.select(F.explode(F.array("a", "b")).alias("tid"), F.xxhash64("a", "b").alias("key"))
    exact = ids.select("tid", F.col("tid").alias("key"))  # texts shorter than n still equal themselves
    keys = cut_lineage(sigs.select("tid", "key").unionByName(exact).distinct())
    lonely = hashes is None or not first.filter("h is null").isEmpty()
    if hashes is None:
        post = first.join(keys, "tid").select("seq", F.col("key").alias("k"), F.lit(True).alias("lone"), F.lit(True).alias("any"))
    else:
        near = cut_lineage(simjoin.hamming_pairs(first.select("h"), None, img - 1))
        ctx = _contexts(first, near, lonely)
        post = ctx.join(keys, "tid").select("seq", F.struct("ctx", "key").alias("k"), "lone", "any")
    where = first.select("seq", "tid")

    def verify(pairs: DataFrame) -> DataFrame:
        t = pairs.join(where.select(F.col("seq").alias("a"), F.col("tid").alias("ta")), "a")
        t = t.join(where.select(F.col("seq").alias("b"), F.col("tid").alias("tb")), "b")
        same = t.filter("ta = tb").select("a", "b")
        uniq = t.filter("ta <> tb").select(F.col("ta").alias("x"), F.col("tb").alias("y")).distinct()
        if found is not None:
            ok = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            ok = simjoin.score_pairs(uniq.select(F.col("x").alias("a"), F.col("y").alias("b")), texts.select("tid", "text"), n, text)
        near = t.join(ok.select(F.col("a").alias("ta"), F.col("b").alias("tb")), ["ta", "tb"]).select("a", "b")
        return same.unionByName(near)

    if hashes is None and found is not None:  # every node is a text of its own and no bucket needs peeling: the similar pairs are the edges
        gone = graph.greedy_dropped(found).select(F.col("node").alias("seq"))
    elif keep_same_image or hashes is None:
        gone = _resolve(post, verify, peel_above)
    else:
        # any earlier kept row with a near image also drops the row: one more kind of edge, no text test
        gone = _same_image_dropped(post, verify, first.filter("h is not null").select("seq", "h"), near)
    gone = cut_lineage(gone.distinct())
    # empty text matches nothing, so collapsed copies of it are kept too, unless the image alone decides
    empty = nodes.filter("not real" if keep_same_image or hashes is None else "not real and h is null")
    kept = first.join(gone, "seq", "left_anti").select("seq", "h", "tid")
    kept = kept.unionByName(empty.select("seq", "h", "tid")).dropDuplicates(["seq"])
    kept = cut_lineage(kept)
    out = nodes.select("seq", "h", "tid").join(kept.select("seq", F.lit(True).alias("kept")), "seq", "left")
    if hashes is None:
        note = F.when(F.col("kept").isNull(), F.lit("dup_pair"))
        return out.select("seq", F.coalesce("kept", F.lit(False)).alias("kept"), note.alias("note"))
    return _notes(out, kept, ids, found, near, keep_same_image)


def _same_image_dropped(post, verify, img_nodes, near):
    """Dropped rows when a near image alone drops a row, and similar text does where one side has no image.

    Of the rows with one hash only the first kept one matters: it drops all later ones. Rows wait until every earlier row of
    their hash has been dropped for another reason; then the next one joins and the order is scanned again.
    """
    sym = cut_lineage(near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    ranked = cut_lineage(rank_in_groups(img_nodes, ["h"], [F.col("seq")], F.floor(F.col("seq") / 100_000), "place"))
    u, v = post.filter("any and lone").alias("x"), post.filter("any").alias("y")
    lone = u.join(v, (F.col("x.k") == F.col("y.k")) & (F.col("x.seq") != F.col("y.seq")))
    lone = cut_lineage(verify(lone.select(F.least("x.seq", "y.seq").alias("a"), F.greatest("x.seq", "y.seq").alias("b")).distinct()))
    depth = cut_lineage(img_nodes.select("h").distinct().withColumn("depth", F.lit(1)))
    while True:
        here = ranked.join(depth, "h")
        active = cut_lineage(here.filter("place <= depth").select("seq", "h"))
        waiting = here.filter("place > depth").select("seq", "h")
        l, r = active.select(F.col("seq").alias("a"), F.col("h").alias("ha")), active.select(F.col("seq").alias("b"), F.col("h").alias("hb"))
        image = l.join(sym.select(F.col("a").alias("ha"), F.col("b").alias("hb")), "ha").join(r, "hb").filter("a < b").select("a", "b")
        same = l.join(r, F.col("ha") == F.col("hb")).filter("a < b").select("a", "b")
        parked = waiting.select(F.col("seq").alias("p"))
        text = lone.join(parked, lone.a == F.col("p"), "left_anti").join(parked, lone.b == F.col("p"), "left_anti")
        gone = cut_lineage(graph.greedy_dropped(image.unionByName(same).unionByName(text)).select(F.col("node").alias("seq")).distinct())
        alive = active.join(gone, "seq", "left_anti").select("h").distinct()
        starved = cut_lineage(waiting.select("h").distinct().join(alive, "h", "left_anti"))
        if starved.isEmpty():
            return gone.unionByName(waiting.select("seq"))
        depth = cut_lineage(depth.join(starved.withColumn("more", F.lit(1)), "h", "left").select("h", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def _notes(out, kept, ids, cand, near, keep_same_image):
    """Why a row was dropped, and what a kept row had met before. ``ids``: tids of texts that are not empty; ``cand``: similar pairs (a, b) of them; ``near``: near hashes."""
    per_hash = kept.filter("h is not null").groupBy("h").agg(F.min("seq").alias("f"))
    sym = near.select(F.col("a").alias("h"), F.col("b").alias("h2")).unionByName(
        near.select(F.col("b").alias("h"), F.col("a").alias("h2")))
    sym = sym.unionByName(per_hash.select("h", F.col("h").alias("h2")))
    img_first = (sym.join(per_hash.select(F.col("h").alias("h2"), "f"), "h2").groupBy("h").agg(F.min("f").alias("img_first")))
    per_text = kept.groupBy("tid").agg(F.min("seq").alias("f"))
    tsym = cand.select(F.col("a").alias("tid"), F.col("b").alias("t2")).unionByName(
        cand.select(F.col("b").alias("tid"), F.col("a").alias("t2")))
    tsym = tsym.unionByName(ids.select("tid", F.col("tid").alias("t2")))
    text_first = (tsym.join(per_text.select(F.col("tid").alias("t2"), "f"), "t2").groupBy("tid").agg(F.min("f").alias("text_first")))
    j = out.join(img_first, "h", "left").join(text_first, "tid", "left")
    same_img = F.coalesce((F.col("h").isNotNull()) & (F.col("img_first") < F.col("seq")), F.lit(False))
    same_text = F.coalesce(F.col("text_first") < F.col("seq"), F.lit(False))
    is_kept = F.coalesce("kept", F.lit(False))
    drop_note = F.lit("dup_pair") if keep_same_image else F.when(same_img & ~same_text, F.lit("dup_image")).otherwise(
        F.lit("dup_pair"))
    note = F.when(~is_kept, drop_note).when(same_img, F.lit("same_image_diff_text")).when(same_text, F.lit("dup_text"))
    return j.select("seq", is_kept.alias("kept"), note.alias("note"))


def image_groups(hashes: DataFrame, threshold: int = 5, id_col: str = "id") -> DataFrame:
    """(id, component) for groups of at least two images that are chained by distances below ``threshold``."""
    h = cut_lineage(hashes.filter("h is not null").select(F.col(id_col).alias("id"), "h"))
    comp = cut_lineage(simjoin.hamming_groups(h.select("h"), threshold - 1))
    labelled = h.join(comp.select(F.col("node").alias("h"), F.col("component").alias("c")), "h", "left")
    labelled = labelled.withColumn("c", F.coalesce("c", "h"))
    heads = labelled.groupBy("c").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return labelled.join(heads, "c").select("id", "component")


def image_rows(samples: DataFrame) -> DataFrame:
    """One row (image_path) per real image of every sample: its ``images`` list, else its ``image_path``; placeholders and blanks go."""
    have = set(samples.columns)
    listed = F.col("images") if "images" in have else F.lit(None).cast("array<string>")
    single = F.array("image_path") if "image_path" in have else F.array().cast("array<string>")
    both = F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(single)
    rows = samples.select(F.explode(both).alias("image_path")).filter("image_path is not null and image_path <> ''")
    return rows.filter(~F.col("image_path").startswith("__"))


def leakage_of_samples(train: DataFrame, held: DataFrame, hashes: DataFrame, threshold: int = 8) -> DataFrame:
    """``leakage_report`` for sample tables with ``images`` or ``image_path``; ``hashes``: image_path, phash.

    With nothing but placeholders on the held-out side nothing was checked and coverage is 0.
    """
    def side(df: DataFrame) -> DataFrame:
        return image_rows(df).distinct().join(hashes, "image_path", "left")

    return leakage_report(side(train), side(held), threshold).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def leakage_pairs(train: DataFrame, held: DataFrame, threshold: int = 8) -> DataFrame:
    """(eval_image, train_image, distance): held-out images that also occur, nearly, in training. Columns: image_path, phash."""
    t = cut_lineage(train.filter("phash is not null").select(F.col("image_path").alias("train_image"), "phash").distinct())
    e = cut_lineage(held.filter("phash is not null").select(F.col("image_path").alias("eval_image"), "phash").distinct())
    pairs = simjoin.hamming_pairs(e.select(F.col("phash").alias("h")), t.select(F.col("phash").alias("h")), threshold - 1)
    return (pairs.join(e, pairs.a == e.phash).drop("phash").join(t, pairs.b == t.phash)
            .select("eval_image", "train_image", "distance"))


def leakage_report(train: DataFrame, held: DataFrame, threshold: int = 8) -> DataFrame:
    """One row of counts. Rows with a path but no hash count as skipped, so "nothing checked" cannot pass for "clean"."""
    def side(df: DataFrame, name: str) -> DataFrame:
        one = df.filter("image_path is not null and image_path <> ''").groupBy("image_path").agg(F.max("phash").alias("p"))
        return one.agg(F.count("p").alias(f"n_{name}_checked"),
                       F.count(F.when(F.col("p").isNull(), 1)).alias(f"n_{name}_skipped"))

    t = cut_lineage(train.filter("phash is not null").groupBy("phash").agg(F.countDistinct("image_path").alias("nt")))
    e = cut_lineage(held.filter("phash is not null").groupBy("phash").agg(F.countDistinct("image_path").alias("ne")))
    pairs = simjoin.hamming_pairs(e.select(F.col("phash").alias("h")), t.select(F.col("phash").alias("h")), threshold - 1)
    hit = pairs.join(e, pairs.a == e.phash).drop("phash").join(t, pairs.b == t.phash)
    n_pairs = hit.agg(F.coalesce(F.sum(F.col("ne") * F.col("nt")), F.lit(0)).alias("n_leak_pairs"))
    n_imgs = hit.select("a", "ne").distinct().agg(F.coalesce(F.sum("ne"), F.lit(0)).alias("n_leak_eval_images"))
    one = one_row(side(held, "eval"), side(train, "train"), n_pairs, n_imgs)
    checked, skipped = F.col("n_eval_checked"), F.col("n_eval_skipped")
    return one.select("*", F.nullif(checked, F.lit(0)).alias("_c")).select(
        "n_eval_checked", "n_train_checked", "n_eval_skipped", "n_train_skipped", "n_leak_pairs", "n_leak_eval_images",
        (checked / F.nullif(checked + skipped, F.lit(0))).alias("coverage"),
        (F.col("n_leak_eval_images") / F.col("_c")).alias("leak_rate"))
