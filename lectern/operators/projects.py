"""Change logs of projects: states, sections and notes, with a reason for every change that is refused.

What a change says by itself is judged before any order is looked at (`_judged` columns). Only what depends on earlier
changes is done in order, and each log in the cheapest way its rule allows:

* states: every change can depend on all lists, so a project's log is folded in slices of `SLICE` changes; the states
  between two slices are a stored table, so a task holds a slice and a state, however long the log.
* sections: an accepted change names the revision and time it replaces, so each one has one possible successor; the
  accepted ones are what the chain from the empty section reaches, found by doubling pointers.
* notes: a change depends on the note's creation and the last status before it, which are windows over one note.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fixed import (
    PROJECT_ACTORS, PROJECT_HORIZONS, PROJECT_LISTS, PROJECT_NOTE_KINDS, PROJECT_NOTE_STATUSES, PROJECT_RESOLVABLE,
    PROJECT_STAGES, STRATEGY_EDITORS,
)
from lectern.functions.text import bind
from lectern.operators.deltas import running_number
from lectern.operators.tables import stored

#: kind: merge, add, update, delete or resolve. A null stage, confidence or list is one the change doesn't name.
LOG = ("project_id string, seq long, kind string, actor string, stage string, confidence double, "
       "lists map<string,array<string>>, field string, position int, text string")
SLICE = 500
LISTING = 100  # changes of a slice whose outcomes hold whole lists
LIST = "array<string>"
STATE = f"struct<place:int,confidence:double,lists:array<{LIST}>,revision:bigint>"
OUTCOME = "array<struct<seq:bigint,reason:string,revision:bigint,place:int,confidence:double,field:int,item:string,size:int,items:array<string>>>"


def folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _one_of(what: str, names: tuple[str, ...]) -> Column:
    return F.lit(f"{what} must be one of: " + ", ".join(names))


def _actor_known() -> Column:
    return F.coalesce(F.trim("actor").isin(*PROJECT_ACTORS), F.lit(False))


def _number_in(names: tuple[str, ...], name: Column) -> Column:
    """Place of a name in a fixed list, from 0; null if it isn't there."""
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(at > 0, (at - 1).cast("int"))


def _judged(log: DataFrame) -> DataFrame:
    """One struct `x` per change: what it asks for, and the reasons it is refused for whatever the state is."""
    kind, text = F.col("kind"), F.trim(F.coalesce("text", F.lit("")))
    edit, stage = kind != "merge", F.trim("stage")
    place, field = _number_in(PROJECT_STAGES, stage), _number_in(PROJECT_LISTS, F.coalesce("field", F.lit("")))
    named = F.array(*[F.try_element_at("lists", F.lit(n)) for n in PROJECT_LISTS])
    excuse = F.size(F.coalesce(F.try_element_at("lists", F.lit("mistakes_or_regrets")), F.array())) + F.size(
        F.coalesce(F.try_element_at("lists", F.lit("repair_actions")), F.array())) > 0
    refusal = (F.when(~_actor_known(), _one_of("updated_by", tuple(sorted(PROJECT_ACTORS))))
               .when(~edit & F.col("stage").isNotNull() & place.isNull(), _one_of("stage", PROJECT_STAGES))
               .when((kind == "resolve") & (text == "") & F.col("position").isNull(), F.lit("item is required"))
               .when(edit & (kind != "resolve") & field.isNull(), F.concat(F.coalesce("field", F.lit("")), F.lit(" is not list-valued")))
               .when(kind.isin("add", "update") & (text == ""), F.lit("item text is required")))
    late = F.when(~F.col("confidence").between(0.0, 1.0), F.lit("stage_confidence must be between 0 and 1"))
    resolvable = F.coalesce(F.col("field").isin(*PROJECT_RESOLVABLE), F.lit(False))
    return log.select("project_id", "seq", F.struct(
        "seq", "kind", refusal.alias("refusal"), F.when(~edit, late).alias("late"), F.when(~edit, place).alias("place"),
        F.coalesce(excuse, F.lit(False)).alias("excuse"), F.when(~edit, F.col("confidence")).alias("confidence"),
        F.when(~edit & F.col("lists").isNotNull(), named).alias("lists"), field.alias("field"), resolvable.alias("resolvable"),
        "position", text.alias("text")).alias("x"))


def _target(state: Column, x: Column) -> Column:
    """(field, position) that an edit is about; a null field where nothing is found."""
    def found(name: str) -> Column:
        number = PROJECT_LISTS.index(name)
        at = F.array_position(F.transform(state["lists"][number], folded), folded(x["text"]))
        return F.when((x["text"] != "") & (at > 0), F.struct(F.lit(number).alias("field"), (at - 1).cast("int").alias("position")))

    given = F.struct(x["field"].alias("field"), x["position"].alias("position"))
    placed = x["resolvable"] & x["position"].between(0, F.size(F.get(state["lists"], x["field"])) - 1)
    nothing = F.struct(F.lit(None).cast("int").alias("field"), F.lit(None).cast("int").alias("position"))
    return F.when(x["kind"] != "resolve", given).otherwise(
        F.coalesce(F.when(placed, given), *map(found, PROJECT_RESOLVABLE), nothing))


def _edited(x: Column, target: Column, values: Column) -> Column:
    at = target["position"]
    rest = F.concat(F.slice(values, 1, F.greatest(at, F.lit(0))),
                    F.slice(values, F.greatest(at, F.lit(0)) + 2, F.size(values)))
    return (F.when(x["kind"] == "add", F.concat(values, F.array(x["text"])))
            .when(x["kind"] == "update", F.transform(values, lambda v, i: F.when(i == at, x["text"]).otherwise(v)))
            .otherwise(rest))


def _clash(lists: Column) -> Column:
    """Why two horizons can't hold what they do; null if they can."""
    def items(name: str) -> Column:
        return F.filter(F.transform(lists[PROJECT_LISTS.index(name)], folded), lambda v: v != "")

    pairs = [(a, b) for i, a in enumerate(PROJECT_HORIZONS) for b in PROJECT_HORIZONS[i + 1:]]
    return F.coalesce(*[bind(F.array_min(F.array_intersect(items(a), items(b))), lambda v, a=a, b=b: F.when(
        v.isNotNull(), F.concat(F.lit("'"), v, F.lit(f"' appears in both {a} and {b}")))) for a, b in pairs])


def _next(held: Column, x: Column, listing: bool) -> Column:
    """State and outcomes after one more change."""
    state = held["state"]

    def judged(target: Column) -> Column:
        values = F.get(state["lists"], target["field"])
        edit = x["kind"] != "merge"
        missed = F.when(edit & target["field"].isNull(), F.lit("item not found")).when(
            x["kind"].isin("update", "delete") & ~F.coalesce(target["position"].between(0, F.size(values) - 1), F.lit(False)),
            F.concat(F.lit("invalid item index for "), F.get(F.array(*map(F.lit, PROJECT_LISTS)), target["field"]), F.lit(": "),
                     F.coalesce(target["position"].cast("string"), F.lit("None"))))
        back = F.when((x["place"] < state["place"]) & ~x["excuse"],
                      F.lit("backwards stage transitions require mistakes_or_regrets or repair_actions"))
        lists = F.when(edit, F.transform(state["lists"], lambda v, i: F.when(
            i == target["field"], _edited(x, target, v)).otherwise(v))).when(
                x["lists"].isNull(), state["lists"]).otherwise(
                    F.zip_with(state["lists"], x["lists"], lambda old, new: F.coalesce(new, old)))
        early = F.coalesce(x["refusal"], missed, back, x["late"])
        return bind(F.when(early.isNull(), lists).otherwise(state["lists"]), lambda new: bind(
            F.coalesce(early, _clash(new), F.lit("")), lambda reason: _after(held, x, target, values, new, reason, listing)))

    return bind(_target(state, x), judged)


def _after(held: Column, x: Column, target: Column, values: Column, lists: Column, reason: Column, listing: bool) -> Column:
    state, good = held["state"], reason == ""
    new = F.struct(F.when(good, F.coalesce(x["place"], state["place"])).otherwise(state["place"]).alias("place"),
                   F.when(good, F.coalesce(x["confidence"], state["confidence"])).otherwise(state["confidence"]).alias("confidence"),
                   F.when(good, lists).otherwise(state["lists"]).alias("lists"),
                   (state["revision"] + good.cast("bigint")).alias("revision"))
    item = F.when(good & x["kind"].isin("add", "update"), x["text"]).when(good, F.get(values, target["position"]))
    kept = F.get(F.when(good, lists).otherwise(state["lists"]), F.coalesce(target["field"], x["field"]))
    items = F.when(x["kind"] != "merge", kept) if listing else F.lit(None).cast(LIST)
    outcome = F.struct(x["seq"].alias("seq"), reason.alias("reason"), (state["revision"] + good.cast("bigint")).alias("revision"),
                       F.when(good, F.coalesce(x["place"], state["place"])).otherwise(state["place"]).alias("place"),
                       F.when(good, F.coalesce(x["confidence"], state["confidence"])).otherwise(state["confidence"]).alias("confidence"),
                       F.coalesce(target["field"], x["field"]).alias("field"),
                       F.when(x["kind"] != "merge", item).alias("item"), F.when(x["kind"] != "merge", F.size(kept)).alias("size"), items.alias("items"))
    return F.struct(new.cast(STATE).alias("state"), F.concat(held["outcomes"], F.array(outcome).cast(OUTCOME)).alias("outcomes"))


def fold_log(log: DataFrame, size: int | None = None, listing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Outcomes (project_id, seq, accepted, reason, revision, stage, confidence, field, item, size, items: the list an edit
    is about, what it put in or took out, the length of that list afterwards and, if `listing`, the list itself) and final
    states (project_id, stage, confidence, revision, lists) of every project. Lists make the outcomes of a slice longer,
    so its slices are shorter then."""
    size = size or (LISTING if listing else SLICE)
    numbered = running_number(_judged(log), ["project_id"], "seq").withColumn("slice", F.floor((F.col("number") - 1) / size))
    numbered = stored(numbered, "changes")
    last = numbered.agg(F.max("slice")).first()[0]
    start = F.struct(F.lit(0).alias("place"), F.lit(0.0).alias("confidence"),
                     F.array_repeat(F.array().cast(LIST), len(PROJECT_LISTS)).alias("lists"), F.lit(0).cast("bigint").alias("revision"))
    parts: list[DataFrame] = []
    for k in range(0 if last is None else last + 1):
        # at most `size` changes
        changes = numbered.where(F.col("slice") == k).groupBy("project_id").agg(
            F.sort_array(F.collect_list(F.struct("number", "x"))).alias("c"))
        if parts:
            changes = changes.join(parts[-1].select("project_id", F.col("f.state").alias("before")), "project_id")
        else:
            changes = changes.withColumn("before", F.lit(None).cast(STATE))
        zero = F.struct(F.coalesce("before", start.cast(STATE)).alias("state"), F.array().cast(OUTCOME).alias("outcomes"))
        f = F.aggregate("c", zero, lambda held, c: _next(held, c["x"], listing))
        parts.append(stored(changes.select("project_id", f.alias("f")), "states").withColumn("slice", F.lit(k)))
    if not parts:
        parts = [log.sparkSession.createDataFrame([], f"project_id string, f struct<state:{STATE},outcomes:{OUTCOME}>, slice int")]
    folds = reduce(DataFrame.union, parts)
    stages, names = (F.array(*map(F.lit, n)) for n in (PROJECT_STAGES, PROJECT_LISTS))
    outcomes = folds.select("project_id", F.explode("f.outcomes").alias("o")).select(
        "project_id", "o.seq", (F.col("o.reason") == "").alias("accepted"), "o.reason", "o.revision",
        F.get(stages, F.col("o.place")).alias("stage"), "o.confidence", F.get(names, F.col("o.field")).alias("field"), "o.item", "o.size", "o.items")
    states = folds.groupBy("project_id").agg(F.max_by("f.state", "slice").alias("s")).select(
        "project_id", F.get(stages, F.col("s.place")).alias("stage"), "s.confidence", "s.revision",
        F.map_filter(F.map_from_arrays(names, "s.lists"), lambda k, v: F.size(v) > 0).alias("lists"))
    return outcomes, states


#: A change to a section. revision and replaces name what it was made from: the next number, and the time of the last one.
SECTION_LOG = ("project_id string, section_id string, seq long, actor string, body string, revision long, replaces string, "
               "updated_at string, protected boolean, justification string, references_prior boolean, confidence double")


def section_log(log: DataFrame) -> DataFrame:
    """Every change with its reason ('' if accepted) and whether the section is protected after it."""
    key = ["project_id", "section_id"]
    actor = F.trim("actor")
    section = F.trim(F.coalesce("section_id", F.lit("")))
    refusal = (F.when(section == "", F.lit("section_id is required"))
               .when(section.rlike(r"[/\\]"), F.lit("section_id must be a slug, not a path"))
               .when(~_actor_known(), _one_of("updated_by", tuple(sorted(PROJECT_ACTORS))))
               .when(F.trim(F.coalesce("body", F.lit(""))) == "", F.lit("section body is required")))
    bad = F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(True)), F.concat(
        F.lit("section "), section, F.lit(" confidence must be between 0 and 1")))
    unexplained = F.when(actor == "reflection", F.when(
        F.trim(F.coalesce("justification", F.lit(""))) == "", F.lit("reflection overwrite of protected section requires justification"))
        .when(~F.coalesce("references_prior", F.lit(False)), F.lit(
            "reflection overwrite of protected section requires references_prior_body=true")))
    # what protection becomes, null: stays
    turned = F.when(actor.isin(*STRATEGY_EDITORS), F.lit(True)).when(actor != "reflection", F.col("protected"))
    rows = stored(log.select(
        "project_id", section.alias("section_id"), "seq", "revision", F.coalesce("replaces", F.lit("")).alias("replaces"),
        F.coalesce("updated_at", F.lit("")).alias("updated_at"), refusal.alias("refusal"), bad.alias("bad"),
        unexplained.alias("unexplained"), turned.alias("turned")), "sections")
    # before a section's first change it has revision 0, no time and no protection
    empty = rows.select(*key).distinct().select(*key, F.lit(None).cast("long").alias("seq"), F.lit(0).cast("long").alias("revision"),
                                                F.lit("").alias("updated_at"), F.lit(None).cast("boolean").alias("turned"))
    usable = rows.where("refusal is null and bad is null")
    sources = usable.select(*key, "seq", "revision", "updated_at", "turned").unionByName(empty).select(
        *key, "seq", (F.col("revision") + 1).alias("wanted"), F.col("updated_at").alias("at"), F.lit(True).alias("source"),
        F.lit(True).alias("free"), "turned")
    offers = usable.select(*key, "seq", F.col("revision").alias("wanted"), F.col("replaces").alias("at"), F.lit(False).alias("source"),
                           F.col("unexplained").isNull().alias("free"), "turned")
    later = Window.partitionBy(*key, "wanted", "at").orderBy(F.asc_nulls_first("seq")).rowsBetween(1, Window.unboundedFollowing)
    offer = F.struct("seq", "turned")
    met = sources.unionByName(offers).withColumns({
        "any": F.min(F.when(~F.col("source"), offer)).over(later),
        "explained": F.min(F.when(~F.col("source") & F.col("free"), offer)).over(later)}).where("source")
    # a node is a change and whether the section is protected after it; its successor is the first offer it lets through
    nodes = met.select(*key, F.coalesce("seq", F.lit(-1)).alias("seq"), F.explode(
        F.when(F.col("seq").isNull(), F.array(F.lit(False))).when(F.col("turned").isNull(), F.array(F.lit(False), F.lit(True)))
        .otherwise(F.array("turned"))).alias("p"), "any", "explained").withColumn(
            "then", F.when(F.col("p"), F.col("explained")).otherwise(F.col("any")))
    jump = stored(nodes.where("then is not null").select(
        *key, "seq", "p", F.col("then.seq").alias("to_seq"), F.coalesce("then.turned", "p").alias("to_p")), "jumps")
    reached = stored(empty.select(*key, F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("p")), "reached")
    while True:
        step = stored(reached.join(jump, [*key, "seq", "p"]).select(
            *key, F.col("to_seq").alias("seq"), F.col("to_p").alias("p")), "step")
        if step.isEmpty():
            break
        reached = stored(reached.union(step), "reached")
        onward = jump.select(*key, F.col("seq").alias("to_seq"), F.col("p").alias("to_p"),
                             F.col("to_seq").alias("next_seq"), F.col("to_p").alias("next_p"))
        jump = stored(jump.join(onward, [*key, "to_seq", "to_p"]).select(
            *key, "seq", "p", F.col("next_seq").alias("to_seq"), F.col("next_p").alias("to_p")), "jumps")
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = rows.join(reached.withColumnRenamed("p", "after"), [*key, "seq"], "left")
    known = known.withColumn("prior", F.last(F.when(F.col("after").isNotNull(), F.struct("revision", "updated_at", "after")), True).over(before))
    prior = F.coalesce("prior", F.struct(F.lit(0).cast("long").alias("revision"), F.lit("").alias("updated_at"), F.lit(False).alias("after")))
    reason = F.coalesce(
        "refusal", F.when(F.col("replaces") != prior["updated_at"], F.lit("stale section update: replaces_updated_at does not match current updated_at")),
        F.when(~F.coalesce(F.col("revision") == prior["revision"] + 1, F.lit(False)), F.concat(
            F.lit("section revision must be "), (prior["revision"] + 1).cast("string"))),
        F.when(prior["after"], F.col("unexplained")), "bad", F.lit(""))
    return known.select(*key, "seq", "revision", "updated_at", reason.alias("reason"), F.coalesce("after", prior["after"]).alias("protected"))


#: A change to notes. kind: append, edit or status; note_id is null for append, value is a note's kind or its new status.
NOTE_LOG = "project_id string, seq long, kind string, actor string, note_id string, value string, text string"


def note_log(log: DataFrame) -> DataFrame:
    """Every change with the note it is about, its reason ('' if accepted), and the note's status after it."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    editor = F.coalesce(F.trim("actor").isin(*STRATEGY_EDITORS), F.lit(False))
    unknown = _one_of("actor", tuple(sorted(PROJECT_ACTORS)))
    rows = stored(log, "notes")
    asked = rows.where("kind = 'append'").withColumn("reason", F.coalesce(
        F.when(~F.coalesce(F.col("value").isin(*PROJECT_NOTE_KINDS), F.lit(False)), _one_of("note kind", tuple(sorted(PROJECT_NOTE_KINDS)))),
        F.when(~_actor_known(), unknown),
        F.when((F.col("value") == "strategy") & ~editor, F.lit("strategy notes can only be created by hermes or human")),
        F.when(blank, F.lit("note text is required")), F.lit("")))
    created = running_number(asked.where("reason = ''"), ["project_id"], "seq").withColumn(
        "note_id", F.format_string("note-%04d", "number"))
    notes = stored(created.select("project_id", "note_id", F.col("value").alias("note_kind"), F.col("seq").alias("born")), "created")
    made = asked.select("project_id", "seq", "reason").join(
        notes.select("project_id", F.col("born").alias("seq"), "note_id"), ["project_id", "seq"], "left").select(
            "project_id", "seq", "note_id", "reason", F.when(F.col("reason") == "", "open").alias("status"))
    # of the changes to a note, only an edit depends on another one: on the last status before it
    changes = rows.where("kind <> 'append'").join(notes, ["project_id", "note_id"], "left")
    strategy = F.col("note_kind") == "strategy"
    missing = F.when(F.col("born").isNull() | (F.col("seq") < F.col("born")), F.concat(F.lit("unknown note_id: "), F.coalesce("note_id", F.lit(""))))
    status = F.coalesce(
        F.when(~_actor_known(), unknown),
        F.when((F.col("kind") == "status") & ~F.coalesce(F.col("value").isin(*PROJECT_NOTE_STATUSES), F.lit(False)),
               _one_of("note status", tuple(sorted(PROJECT_NOTE_STATUSES)))),
        F.when((F.col("kind") == "edit") & blank, F.lit("note text is required")), missing,
        F.when((F.col("kind") == "status") & strategy & (F.col("value") != "open"), F.lit(
            "strategy notes always stay open and cannot be archived or deleted")),
        F.when((F.col("kind") == "status") & strategy & ~editor, F.lit("strategy notes can only be managed by hermes or human")))
    changes = changes.withColumn("reason", status)
    upto = Window.partitionBy("project_id", "note_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    set_ = F.when((F.col("kind") == "status") & F.col("reason").isNull(), F.col("value"))
    changes = changes.withColumn("status", F.coalesce(F.last(set_, True).over(upto), F.when(missing.isNull(), "open")))
    changed = changes.select("project_id", "seq", "note_id", F.coalesce(
        "reason", F.when((F.col("kind") == "edit") & (F.col("status") == "deleted"), F.lit("cannot edit a deleted note")),
        F.when((F.col("kind") == "edit") & strategy & ~editor, F.lit("strategy notes can only be edited by hermes or human")),
        F.lit("")).alias("reason"), F.when(missing.isNull(), F.col("status")).alias("status"))
    return made.unionByName(changed)
