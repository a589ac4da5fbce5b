"""Project states, list edits and notes out of the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.fixed import PROJECT_ACTORS, PROJECT_NOTE_KINDS, PROJECT_NOTE_STATUSES, PROJECT_STAGES
from lectern.operators.projects import fold_log, note_log, section_log
from lectern.plans.corpus import table
from lectern.plans.registry import query

STAGES = "[" + ", ".join(f"'{s}'" for s in PROJECT_STAGES) + ", 'nowhere']"
ACTORS = ", ".join(sorted(PROJECT_ACTORS))
MERGES = f"""
WITH RECURSIVE d AS (
  SELECT 'p' || user_id AS project_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    CASE WHEN event_type = 'error' THEN 'lint' WHEN event_id % 13 = 0 THEN 'bot' ELSE 'cli' END AS actor,
    CASE WHEN event_type = 'view' THEN {STAGES}[1 + event_id % {len(PROJECT_STAGES) + 1}] END AS stage,
    event_id % 4 = 0 AS slip, CASE WHEN event_type = 'click' THEN value / 100 END AS confidence,
    CASE WHEN event_type = 'signup' THEN ['Item ' || (event_id % 5), 'x' || (event_id % 3)] END AS objectives,
    CASE WHEN event_type = 'purchase' THEN [' item  ' || (event_id % 5)] END AS focus FROM events),
steps AS (
  SELECT *, list_position({STAGES}, stage) AS place FROM d),
fold AS (
  SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS rn, '' AS reason, CAST(0 AS BIGINT) AS revision,
    1 AS place, CAST(0.0 AS DOUBLE) AS confidence, CAST([] AS VARCHAR[]) AS objectives, CAST([] AS VARCHAR[]) AS focus FROM d
  UNION ALL
  SELECT project_id, seq, rn, reason, revision + CASE WHEN reason = '' THEN 1 ELSE 0 END,
    CASE WHEN reason = '' THEN np ELSE op END, CASE WHEN reason = '' THEN nc ELSE oc END,
    CASE WHEN reason = '' THEN no ELSE oo END, CASE WHEN reason = '' THEN nf ELSE off END
  FROM (
    SELECT *, CASE WHEN actor NOT IN ('cli', 'hermes', 'human', 'reflection') THEN 'updated_by must be one of: {ACTORS}'
      WHEN np = {len(PROJECT_STAGES) + 1} THEN 'stage must be one of: {", ".join(PROJECT_STAGES)}'
      WHEN np < op AND NOT slip THEN 'backwards stage transitions require mistakes_or_regrets or repair_actions'
      WHEN nc < 0 OR nc > 1 THEN 'stage_confidence must be between 0 and 1'
      WHEN len(clash) > 0 THEN '''' || list_sort(clash)[1] || ''' appears in both main_objectives and next_focus' ELSE '' END AS reason
    FROM (
      SELECT s.project_id, s.seq, s.rn, s.actor, s.slip, f.revision, f.place AS op, coalesce(s.place, f.place) AS np,
        f.confidence AS oc, coalesce(s.confidence, f.confidence) AS nc, f.objectives AS oo, f.focus AS off,
        coalesce(s.objectives, f.objectives) AS no, coalesce(s.focus, f.focus) AS nf,
        list_intersect(list_transform(coalesce(s.objectives, f.objectives), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))),
                       list_transform(coalesce(s.focus, f.focus), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))))) AS clash
      FROM fold f JOIN steps s ON s.project_id = f.project_id AND s.rn = f.rn + 1)))"""


def _merges(spark, folder):
    e, kind = F.col("event_id"), F.col("event_type")
    names = F.array(*map(F.lit, (*PROJECT_STAGES, "nowhere")))
    given = F.map_from_entries(F.array_compact(F.array(
        F.when(e % 4 == 0, F.struct(F.lit("mistakes_or_regrets"), F.array(F.lit("slip")))),
        F.when(kind == "signup", F.struct(F.lit("main_objectives"), F.array(
            F.concat(F.lit("Item "), (e % 5).cast("string")), F.concat(F.lit("x"), (e % 3).cast("string"))))),
        F.when(kind == "purchase", F.struct(F.lit("next_focus"), F.array(F.concat(F.lit(" item  "), (e % 5).cast("string"))))))))
    return table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"), e.alias("seq"), F.lit("merge").alias("kind"),
        F.when(kind == "error", "lint").when(e % 13 == 0, "bot").otherwise("cli").alias("actor"),
        F.when(kind == "view", F.get(names, (e % (len(PROJECT_STAGES) + 1)).cast("int"))).alias("stage"),
        F.when(kind == "click", F.col("value") / 100).alias("confidence"), given.alias("lists"),
        F.lit(None).cast("string").alias("field"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("text"))


@query("project_log_checked", "G24 H21", MERGES + " SELECT project_id, seq, reason = '' AS accepted, reason FROM fold WHERE rn > 0")
def project_log_checked(spark, folder):
    """Each proposed change of a project with the reason it was refused for, if it was."""
    return fold_log(_merges(spark, folder))[0].select("project_id", "seq", "accepted", "reason")


@query("project_state_merged", "G24 H21", MERGES + f"""
SELECT project_id, {STAGES}[place] AS stage, round(confidence, 6) AS confidence, revision,
  array_to_string(objectives, '|') AS objectives, array_to_string(focus, '|') AS focus
FROM fold QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY rn DESC) = 1""")
def project_state_merged(spark, folder):
    """The state that a project's accepted changes lead to."""
    states = fold_log(_merges(spark, folder))[1]

    def items(name):
        return F.coalesce(F.array_join(F.try_element_at("lists", F.lit(name)), "|"), F.lit(""))

    return states.select("project_id", "stage", F.round("confidence", 6).alias("confidence"), "revision",
                         items("main_objectives").alias("objectives"), items("next_focus").alias("focus"))


EDITS = r"""
WITH RECURSIVE d AS (
  SELECT 'p' || user_id AS project_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    CASE event_type WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'delete' WHEN 'view' THEN 'resolve' ELSE 'add' END AS kind,
    event_id % 4 AS position, CASE WHEN event_id % 19 = 0 THEN '  ' ELSE ' Task  ' || (event_id % 6) END AS text,
    event_id % 3 = 0 AS by_place FROM events),
fold AS (
  SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS rn, '' AS reason, CAST(NULL AS VARCHAR) AS item,
    CAST([] AS VARCHAR[]) AS items FROM d
  UNION ALL
  SELECT project_id, seq, rn, reason, CASE WHEN reason = '' THEN CASE WHEN kind IN ('add', 'update') THEN trim(text) ELSE items[place + 1] END END, CASE WHEN reason <> '' THEN items WHEN kind = 'add' THEN list_append(items, trim(text))
    WHEN kind = 'update' THEN list_concat(list_append(items[1:place], trim(text)), items[place + 2:])
    ELSE list_concat(items[1:place], items[place + 2:]) END
  FROM (
    SELECT *, CASE
      WHEN kind = 'resolve' AND trim(text) = '' AND NOT by_place THEN 'item is required'
      WHEN kind = 'resolve' AND place < 0 THEN 'item not found'
      WHEN kind IN ('add', 'update') AND trim(text) = '' THEN 'item text is required'
      WHEN kind IN ('update', 'delete') AND place >= len(items) THEN 'invalid item index for next_focus: ' || place ELSE '' END AS reason
    FROM (
      SELECT s.*, f.items, CASE WHEN kind <> 'resolve' THEN position
        WHEN by_place AND position < len(f.items) THEN position
        WHEN trim(text) = '' THEN -1
        ELSE coalesce(list_position(list_transform(f.items, lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))), lower(regexp_replace(trim(text), '\s+', ' ', 'g'))), 0) - 1 END AS place
      FROM fold f JOIN d s ON s.project_id = f.project_id AND s.rn = f.rn + 1)))
SELECT project_id, seq, reason, item, array_to_string(items, '|') AS items FROM fold WHERE rn > 0"""


@query("project_list_edits", "G24 H21 H37", EDITS)
def project_list_edits(spark, folder):
    """Items of a project list added, changed, removed by index, and resolved by index or by their text; the whole list after each."""
    e, kind = F.col("event_id"), F.col("event_type")
    action = F.when(kind == "click", "update").when(kind == "purchase", "delete").when(kind == "view", "resolve").otherwise("add")
    text = F.when(e % 19 == 0, "  ").otherwise(F.concat(F.lit(" Task  "), (e % 6).cast("string")))
    placed = (action != "resolve") | (e % 3 == 0)
    log = table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"), e.alias("seq"), action.alias("kind"),
        F.lit("human").alias("actor"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("map<string,array<string>>").alias("lists"), F.lit("next_focus").alias("field"),
        F.when(placed, (e % 4).cast("int")).alias("position"), text.alias("text"))
    return fold_log(log, listing=True)[0].select("project_id", "seq", "reason", "item", F.coalesce(F.array_join("items", "|"), F.lit("")).alias("items"))


# Good changes follow each other; of the others some repeat a revision, some come without a reason.
SECTION_ROWS = """
d AS (SELECT 'p' || user_id AS project_id, event_type AS section_id, event_id AS seq,
    CASE WHEN event_id % 11 = 0 THEN 'bot' ELSE ['hermes', 'cli', 'reflection', 'human', 'cli', 'reflection'][1 + event_id % 6] END AS actor,
    CASE WHEN event_id % 7 = 3 THEN ' ' ELSE 'b' END AS body, 't' || event_id AS updated_at, event_id % 5 <> 4 AS good,
    CASE WHEN event_id % 4 = 1 THEN event_id % 8 = 1 END AS protected,
    CASE WHEN event_id % 3 <> 2 THEN 'why' ELSE '' END AS justification, event_id % 9 <> 2 AS references_prior,
    CASE WHEN event_id % 17 = 0 THEN 1.5 ELSE 0.5 END AS confidence FROM events),
g AS (SELECT *, good AND actor <> 'bot' AND body <> ' ' AND confidence = 0.5 AND (actor <> 'reflection' OR (justification <> '' AND references_prior)) AS kept FROM d),
log AS (SELECT *, 1 + coalesce(sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER w, 0) AS revision,
    coalesce(CASE WHEN good THEN last_value(CASE WHEN kept THEN updated_at END IGNORE NULLS) OVER w
      ELSE first_value(CASE WHEN kept THEN updated_at END IGNORE NULLS) OVER w END, '') AS replaces FROM g
  WINDOW w AS (PARTITION BY project_id, section_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _section_changes(spark, folder):
    e = F.col("event_id")
    actors = F.array(*map(F.lit, ("hermes", "cli", "reflection", "human", "cli", "reflection")))
    rows = table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"), F.col("event_type").alias("section_id"),
        e.alias("seq"), F.when(e % 11 == 0, "bot").otherwise(F.get(actors, (e % 6).cast("int"))).alias("actor"),
        F.when(e % 7 == 3, " ").otherwise("b").alias("body"), F.concat(F.lit("t"), e.cast("string")).alias("updated_at"),
        (e % 5 != 4).alias("good"), F.when(e % 4 == 1, e % 8 == 1).alias("protected"),
        F.when(e % 3 != 2, "why").otherwise("").alias("justification"), (e % 9 != 2).alias("references_prior"),
        F.when(e % 17 == 0, 1.5).otherwise(0.5).alias("confidence"))
    kept = F.col("good") & (F.col("actor") != "bot") & (F.col("body") != " ") & (F.col("confidence") == 0.5) & (
        (F.col("actor") != "reflection") | ((F.col("justification") != "") & F.col("references_prior")))
    before = Window.partitionBy("project_id", "section_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    time = F.when(kept, F.col("updated_at"))
    return rows.withColumns({
        "revision": 1 + F.coalesce(F.sum(kept.cast("long")).over(before), F.lit(0)),
        "replaces": F.coalesce(F.when(F.col("good"), F.last(time, True).over(before)).otherwise(F.first(time, True).over(before)), F.lit(""))})


@query("project_sections_checked", "G24 H21", "WITH RECURSIVE " + SECTION_ROWS.replace("log AS (SELECT *,", """log AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, section_id ORDER BY seq) AS rn,""") + f""",
fold AS (
  SELECT DISTINCT project_id, section_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, '' AS reason, CAST(0 AS BIGINT) AS held,
    '' AS stamp, FALSE AS protected FROM log
  UNION ALL
  SELECT project_id, section_id, rn, seq, reason, CASE WHEN reason = '' THEN held + 1 ELSE held END,
    CASE WHEN reason = '' THEN updated_at ELSE stamp END,
    CASE WHEN reason <> '' OR actor = 'reflection' THEN was WHEN actor IN ('hermes', 'human') THEN TRUE ELSE coalesce(asked, was) END
  FROM (
    SELECT l.project_id, l.section_id, l.rn, l.seq, l.actor, l.updated_at, l.protected AS asked, f.held, f.stamp, f.protected AS was, CASE
      WHEN l.actor = 'bot' THEN 'updated_by must be one of: {ACTORS}'
      WHEN trim(l.body) = '' THEN 'section body is required'
      WHEN l.replaces <> f.stamp THEN 'stale section update: replaces_updated_at does not match current updated_at'
      WHEN l.revision <> f.held + 1 THEN 'section revision must be ' || (f.held + 1)
      WHEN f.protected AND l.actor = 'reflection' AND l.justification = '' THEN 'reflection overwrite of protected section requires justification'
      WHEN f.protected AND l.actor = 'reflection' AND NOT l.references_prior THEN 'reflection overwrite of protected section requires references_prior_body=true'
      WHEN l.confidence > 1 THEN 'section ' || l.section_id || ' confidence must be between 0 and 1' ELSE '' END AS reason
    FROM fold f JOIN log l ON l.project_id = f.project_id AND l.section_id = f.section_id AND l.rn = f.rn + 1))
SELECT project_id, section_id, seq, reason, protected FROM fold WHERE rn > 0""")
def project_sections_checked(spark, folder):
    """Changes to sections, each made from a revision and a time: refused where another one came first."""
    return section_log(_section_changes(spark, folder)).select("project_id", "section_id", "seq", "reason", "protected")


@query("project_note_changes", "F17 G24 H21", f"""
WITH d AS (
  SELECT 'p' || user_id AS project_id, event_id AS seq, event_type,
    CASE event_type WHEN 'view' THEN 'append' WHEN 'click' THEN 'append' WHEN 'purchase' THEN 'edit' ELSE 'status' END AS kind,
    CASE WHEN event_id % 13 = 0 THEN 'bot' ELSE ['cli', 'human', 'reflection', 'hermes'][1 + event_id % 4] END AS actor,
    'note-' || lpad(CAST(1 + event_id % 3 AS VARCHAR), 4, '0') AS asked,
    CASE WHEN event_type IN ('view', 'click') THEN ['risk', 'strategy', 'decision', 'gossip'][1 + event_id % 4 + CASE WHEN event_id % 8 < 4 THEN 0 ELSE -(event_id % 4 // 2) END]
      ELSE ['open', 'deleted', 'superseded', 'lost', 'incorporated'][1 + event_id % 5] END AS value,
    CASE WHEN event_id % 6 = 5 THEN ' ' ELSE 'x' END AS text FROM events),
a AS (
  SELECT *, CASE WHEN value = 'gossip' THEN 'note kind must be one of: {", ".join(sorted(PROJECT_NOTE_KINDS))}'
    WHEN actor = 'bot' THEN 'actor must be one of: {ACTORS}'
    WHEN value = 'strategy' AND actor NOT IN ('hermes', 'human') THEN 'strategy notes can only be created by hermes or human'
    WHEN trim(text) = '' THEN 'note text is required' ELSE '' END AS reason FROM d WHERE kind = 'append'),
n AS (SELECT project_id, seq AS born, value AS note_kind,
    'note-' || lpad(CAST(row_number() OVER (PARTITION BY project_id ORDER BY seq) AS VARCHAR), 4, '0') AS note_id FROM a WHERE reason = ''),
c AS (
  SELECT d.project_id, d.seq, d.kind, d.actor, d.asked AS note_id, d.value, n.note_kind, n.born IS NULL OR d.seq < n.born AS missing,
    CASE WHEN d.actor = 'bot' THEN 'actor must be one of: {ACTORS}'
      WHEN d.kind = 'status' AND d.value = 'lost' THEN 'note status must be one of: {", ".join(sorted(PROJECT_NOTE_STATUSES))}'
      WHEN d.kind = 'edit' AND trim(d.text) = '' THEN 'note text is required'
      WHEN n.born IS NULL OR d.seq < n.born THEN 'unknown note_id: ' || d.asked
      WHEN d.kind = 'status' AND n.note_kind = 'strategy' AND d.value <> 'open' THEN 'strategy notes always stay open and cannot be archived or deleted'
      WHEN d.kind = 'status' AND n.note_kind = 'strategy' AND d.actor NOT IN ('hermes', 'human') THEN 'strategy notes can only be managed by hermes or human'
    END AS early
  FROM d LEFT JOIN n ON n.project_id = d.project_id AND n.note_id = d.asked WHERE d.kind <> 'append'),
s AS (
  SELECT c.*, CASE WHEN missing THEN NULL ELSE coalesce((SELECT max_by(o.value, o.seq) FROM c o WHERE o.project_id = c.project_id AND o.note_id = c.note_id
    AND o.kind = 'status' AND o.early IS NULL AND o.seq <= c.seq), 'open') END AS status FROM c)
SELECT project_id, seq, note_id, coalesce(early, CASE WHEN kind = 'edit' AND status = 'deleted' THEN 'cannot edit a deleted note'
  WHEN kind = 'edit' AND note_kind = 'strategy' AND actor NOT IN ('hermes', 'human') THEN 'strategy notes can only be edited by hermes or human' ELSE '' END) AS reason, status
FROM s
UNION ALL
SELECT a.project_id, a.seq, n.note_id, reason, CASE WHEN reason = '' THEN 'open' END FROM a LEFT JOIN n ON n.project_id = a.project_id AND n.born = a.seq""")
def project_note_changes(spark, folder):
    """Notes appended, edited and given a status, with the rules for strategy and deleted notes."""
    e, event = F.col("event_id"), F.col("event_type")
    kinds, statuses, actors = (F.array(*map(F.lit, names)) for names in (
        ("risk", "strategy", "decision", "gossip"), ("open", "deleted", "superseded", "lost", "incorporated"),
        ("cli", "human", "reflection", "hermes")))
    append = event.isin("view", "click")
    note = F.get(kinds, (e % 4 - F.when(e % 8 < 4, 0).otherwise(F.floor((e % 4) / 2))).cast("int"))
    return note_log(table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"), e.alias("seq"),
        F.when(append, "append").when(event == "purchase", "edit").otherwise("status").alias("kind"),
        F.when(e % 13 == 0, "bot").otherwise(F.get(actors, (e % 4).cast("int"))).alias("actor"),
        F.when(~append, F.format_string("note-%04d", 1 + e % 3)).alias("note_id"),
        F.when(append, note).otherwise(F.get(statuses, (e % 5).cast("int"))).alias("value"),
        F.when(e % 6 == 5, " ").otherwise("x").alias("text")))


@query("project_notes_checked", "F17 H37", f"""
WITH n AS (
  SELECT event_id, event_type AS kind0, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'note-x' ELSE NULL END AS given,
    CASE event_type WHEN 'view' THEN 'strategy' WHEN 'click' THEN 'decision' WHEN 'signup' THEN 'risk' WHEN 'error' THEN 'gossip' ELSE 'deadline' END AS kind,
    CASE event_id % 6 WHEN 0 THEN 'superseded' WHEN 1 THEN 'lost' WHEN 2 THEN '' END AS status, event_id % 5 = 0 AS deleted FROM events),
m AS (SELECT *, coalesce(nullif(given, ''), 'note-' || format('{{:04d}}', event_id + 1)) AS note_id,
  coalesce(nullif(status, ''), CASE WHEN deleted THEN 'deleted' ELSE 'open' END) AS full_status FROM n)
SELECT event_id, note_id, CASE WHEN kind = 'gossip' THEN 'note kind must be one of: {", ".join(sorted(PROJECT_NOTE_KINDS))}'
  WHEN full_status = 'lost' THEN 'note status must be one of: {", ".join(sorted(PROJECT_NOTE_STATUSES))}' ELSE '' END AS reason,
  CASE WHEN kind = 'gossip' OR full_status = 'lost' THEN NULL WHEN full_status = 'open' AND kind <> 'strategy' THEN 'incorporated' ELSE full_status END AS status
FROM m""")
def project_notes_checked(spark, folder):
    """Notes with defaults filled in, refused ones with a reason; open notes that are no strategy are incorporated."""
    e, event = F.col("event_id"), F.col("event_type")
    notes = table(spark, folder, "events").select(
        "event_id", F.when(e % 10 == 0, "").when(e % 10 == 1, "note-x").alias("given"),
        F.when(event == "view", "strategy").when(event == "click", "decision").when(event == "signup", "risk")
        .when(event == "error", "gossip").otherwise("deadline").alias("kind"),
        F.when(e % 6 == 0, "superseded").when(e % 6 == 1, "lost").when(e % 6 == 2, "").alias("status"), (e % 5 == 0).alias("deleted"))
    status = F.coalesce(F.nullif("status", F.lit("")), F.when(F.col("deleted"), "deleted").otherwise("open"))
    reason = F.when(~F.col("kind").isin(*PROJECT_NOTE_KINDS), F.lit("note kind must be one of: " + ", ".join(sorted(PROJECT_NOTE_KINDS)))).when(
        ~F.col("full").isin(*PROJECT_NOTE_STATUSES), F.lit("note status must be one of: " + ", ".join(sorted(PROJECT_NOTE_STATUSES)))).otherwise("")
    incorporated = F.when((F.col("full") == "open") & (F.col("kind") != "strategy"), "incorporated").otherwise(F.col("full"))
    return notes.withColumn("full", status).withColumn("reason", reason).select(
        "event_id", F.coalesce(F.nullif("given", F.lit("")), F.format_string("note-%04d", e + 1)).alias("note_id"), "reason",
        F.when(F.col("reason") == "", incorporated).alias("status"))
