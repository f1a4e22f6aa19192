"""The eight verbs over a store. Each returns a DataFrame; verbs that write take the clock as an argument."""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, temporal, text
from ..operators import extraction, graphs, lifecycle, relational
from ..operators.membership import ComponentStore
from ..operators.postings import FullTextIndex
from ..operators.relational import resolve_scope
from ..runtime import cut
from ..sources.store import MemoryStore, conform, decode_communities, keep_new
from ..schemas import TABLES
from .retrieval import ContextRequest, MemoryTables, assemble_context
from .sessions import ContextCache, Sessions, TokenBucket


def _micros(t: dt.datetime) -> int:
    return int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


class MemoryEngine:
    """sessions, cache and limiter are the driver-side state of interactive use; without them verbs run unlimited."""

    def __init__(self, store: MemoryStore, namespaces: tuple[str, ...] = ("org", "personal", "private"), sessions: Sessions | None = None,
                 cache: ContextCache | None = None, limiter: TokenBucket | None = None, indexed: bool = False):
        """indexed: facts are indexed for full-text search as they are stored, and contexts read the index."""
        self.content_index, self.keys_index = (FullTextIndex(store.spark, f"{store.path}/_index/{x}") if indexed else None for x in ("content", "keys"))
        self.store, self.namespaces = store, list(namespaces)
        self.sessions, self.cache, self.limiter = sessions or Sessions(), cache, limiter

    def _allow(self, now: dt.datetime | None) -> None:
        if self.limiter and now is not None and not self.limiter.allow(now):
            raise RuntimeError("rate limit exceeded")

    def _wrote(self, rows: DataFrame | None = None) -> None:
        """Forgets cached contexts of the scopes of rows, or of all of them."""
        if self.cache is None:
            return
        if rows is None or "scope" not in rows.columns:
            self.cache.rows.clear()
            return
        for r in rows.select("scope").distinct().collect():  # scopes are few: they are folders
            self.cache.clear_scope(r["scope"])

    # -- writes -------------------------------------------------------------------------------------------
    def ingest(self, episodes: DataFrame, now: dt.datetime) -> DataFrame:
        """Stores episodes (source_type, source_id, content, t_ref, scope, ...) once; returns their ids. Rows
        with an empty required field are refused: see rejected()."""
        good = episodes.where(self._valid(episodes))
        rows = good.withColumns({"episode_id": ids.episode_id("source_type", "source_id", F.col("t_ref"), "scope"),
                                 "t_ingested": F.coalesce(F.col("t_ingested"), temporal.ts(now)) if "t_ingested" in good.columns else temporal.ts(now),
                                 "visibility_scope": F.coalesce(F.col("visibility_scope"), F.col("scope")) if "visibility_scope" in good.columns else F.col("scope")})
        rows = rows.where(F.lower("scope").isin([n.lower() for n in self.namespaces]))
        self._allow(now)
        self.store.insert("episode", rows, _micros(now))
        self._wrote(rows)
        return rows.select("episode_id").distinct()

    @staticmethod
    def _valid(df: DataFrame):
        test = F.col("t_ref").isNotNull()
        for c in ("source_type", "source_id", "content", "scope"):
            test = test & F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
        return test

    def rejected(self, episodes: DataFrame) -> DataFrame:
        return episodes.where(~self._valid(episodes))

    def add_facts(self, facts: DataFrame, now: dt.datetime, embedder=None) -> DataFrame:
        """Stores facts once, with ids and index keys: dates, and names of the entities they link to. embedder: Column
        of text to Column of a vector."""
        rows = facts.withColumns({"fact_id": ids.fact_id("fact_type", "content", "source_episode", F.col("t_valid")), "index_keys": text.index_keys("content", "t_valid"), "t_ingested": temporal.ts(now)})
        rows = self._with_names(rows, self.store.read("entity"))
        if embedder:
            quote = F.col("quote") if "quote" in rows.columns else F.lit("")
            rows = self._embedded(rows, embedder(F.concat_ws("\n", "fact_type", "content", quote)))
        self._insert_facts(rows, _micros(now))
        self._wrote(rows)
        return rows.select("fact_id").distinct()

    @staticmethod
    def _embedded(rows: DataFrame, vector) -> DataFrame:
        """rows with their vectors; if the provider fails, the facts are stored without one and reembed() finds them."""
        try:
            return cut(rows.withColumn("embedding", vector))
        except Exception as e:  # of any provider
            warnings.warn(f"facts are stored without vectors: {e}")
            return rows.withColumn("embedding", F.lit(None).cast("array<double>"))

    def _insert_facts(self, rows: DataFrame, version: int) -> None:
        if self.content_index is None:
            return self.store.insert("fact", rows, version)
        new = cut(keep_new(conform(rows, TABLES["fact"]), self.store.read("fact"), "fact_id"))
        self.store.append("fact", new, version)
        self.content_index.add(new, "fact_id", "content")
        self.keys_index.add(new.withColumn("index_keys", F.array_join("index_keys", " ")), "fact_id", "index_keys")

    @staticmethod
    def _with_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
        """index_keys with the names of linked entities, so a fact is found by them."""
        if "entity_links" not in facts.columns:
            return facts
        names = relational.entity_keys(facts.select("fact_id", "entity_links").distinct(), entities)
        both = F.concat("index_keys", F.coalesce("names", F.array().cast("array<string>")))
        return facts.join(names, "fact_id", "left").withColumn("index_keys", F.array_sort(F.array_distinct(both))).drop("names")

    def extract(self, episodes: DataFrame, now: dt.datetime, candidates=None) -> dict[str, DataFrame]:
        """Entities, facts and edges of stored episodes, written once; returns the stored rows of the three."""
        known = self.store.read("entity")
        found = extraction.entities_of(episodes, candidates)
        resolved = relational.resolve_names(found.select(F.col("canonical_name").alias("name")).distinct(), known).select("name", F.col("entity_id").alias("_known"))
        found = found.join(resolved, F.col("canonical_name") == F.col("name"), "left").withColumn("entity_id", F.coalesce("_known", "entity_id")).drop("name", "_known")
        fresh = found.dropDuplicates(["entity_id"]).withColumns({"canonical_name_normalized": text.normalize("canonical_name"), "aliases": F.array().cast("array<string>")})
        facts = extraction.facts_of(episodes)
        links = found.groupBy("episode_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_links"))
        facts = facts.join(links, "episode_id", "left").withColumns({"entity_links": F.coalesce("entity_links", F.array().cast("array<string>")), "t_ingested": temporal.ts(now)})
        names = known.select("entity_id", "canonical_name", "aliases").unionByName(fresh.select("entity_id", "canonical_name", "aliases"))
        facts = self._with_names(facts, names)
        edges = extraction.edges_of(found, facts).withColumn("t_ingested", temporal.ts(now))
        v = _micros(now)
        self.store.insert("entity", fresh, v)
        self._insert_facts(facts, v)
        self.relate(edges, now)
        self._wrote(episodes)
        stored = lambda table, rows, key: self.store.read(table).join(rows.select(key).distinct(), key, "left_semi")
        own = episodes.select(F.col("episode_id").alias("source_episode")).distinct()
        facts_now = self.store.read("fact").join(own, "source_episode", "left_semi")
        ends = facts_now.select(F.col("fact_id").alias("out_id")).union(own.select("source_episode"))
        edges_now = self.store.read("edge").where("relation IN ('mentioned_in', 'involved_in')").join(ends, "out_id", "left_semi")
        return {"entities": stored("entity", edges_now.select(F.col("in_id").alias("entity_id")), "entity_id"), "facts": facts_now, "links": edges_now}

    def relate(self, edges: DataFrame, now: dt.datetime) -> None:
        """Stores edges; older versions of a triple that a new one supersedes are closed by new versions. Where an edge does
        not say: strength 1.0, confidence 0.8, valid and known from now on, id by its content."""
        given = lambda c, other: F.coalesce(F.col(c), other) if c in edges.columns else other
        edges = edges.withColumns({"strength": given("strength", F.lit(1.0)), "confidence": given("confidence", F.lit(0.8)), "t_valid": given("t_valid", temporal.ts(now)), "t_ingested": given("t_ingested", temporal.ts(now))})
        edges = edges.withColumn("edge_id", given("edge_id", ids.edge_id("in_id", "relation", "out_id", F.col("t_valid"))))
        old = self.store.read("edge")
        new = keep_new(conform(edges, TABLES["edge"]), old, "edge_id")
        n = new.select("in_id", "relation", "out_id", "t_valid", "t_ingested")
        closing = (old.alias("o").join(n.alias("n"), ["in_id", "relation", "out_id"]).where(temporal.versions_conflict("o", "n"))
                   .groupBy(F.col("o.edge_id").alias("edge_id")).agg(F.min("n.t_valid").alias("_v"), F.min("n.t_ingested").alias("_i")))
        closed = old.join(closing, "edge_id").withColumns({"t_invalid": F.col("_v"), "t_invalid_ingested": F.col("_i")}).drop("_v", "_i")
        v = _micros(now)
        self.store.append("edge", closed, v)
        self.store.append("edge", new, v)

    def resolve(self, candidates: DataFrame, now: dt.datetime) -> DataFrame:
        """(name, entity_id) of candidates (entity_type, canonical_name, aliases); unknown ones are stored."""
        known = self.store.read("entity")
        self.store.insert("entity", relational.new_entities(candidates, known), _micros(now))
        return relational.resolve_names(candidates.select(F.col("canonical_name").alias("name")).distinct(), self.store.read("entity"))

    def resolve_typed(self, entity_type: str, names: list[str], now: dt.datetime) -> DataFrame:
        """resolve() for names of one type: person, company, location, event, technology or concept."""
        candidates = self.store.spark.createDataFrame([(entity_type, n, []) for n in names], "entity_type string, canonical_name string, aliases array<string>")
        return self.resolve(candidates, now)

    def invalidate(self, requests: DataFrame, now: dt.datetime, dry_run: bool = False) -> DataFrame:
        plan = lifecycle.invalidate(self.store.read("fact"), requests, now)
        done = cut(plan.select("fact_id", "t_invalid")) if not dry_run else plan.select("fact_id", "t_invalid")
        if not dry_run:
            self.store.append("fact", plan, _micros(now))
            self._wrote()
        return done

    def supersede_metric(self, fact_id: str, new_value: float, t_invalid: dt.datetime, now: dt.datetime) -> DataFrame:
        """Invalidates a metric for a newer value; an unknown id changes nothing."""
        return self.invalidate(self.store.spark.createDataFrame([(fact_id, f"Superseded by {new_value:g}", t_invalid)], "fact_id string, reason string, t_invalid timestamp_ntz"), now)

    def reembed(self, provider: str, model: str, dimension: int, embedder, now: dt.datetime, batch: int | None = None) -> dict:
        """Moves all vectors to another model: facts get a staged vector (batch of them at a time, or all), and when
        none is left the staged vectors become the vectors. The schema row tells where it stands, so a run that
        stopped goes on. embedder: Column of text to Column of a vector. Returns status and the facts staged."""
        s, v = self.store, _micros(now)
        rows = s.versions("embedding_schema").orderBy(F.col("_version").desc()).limit(1).collect()
        own = rows[0] if rows else None
        target = (provider, model, dimension)
        if own and own["status"] == "ready" and (own["provider"], own["model"], own["dimension"]) == target:
            return {"status": "ready", "staged": 0}
        before = (own["provider"], own["model"], own["dimension"]) if own else (provider, None, None)
        facts = s.read("fact")
        going_on = own is not None and own["status"] == "migrating" and (own["target_provider"], own["target_model"], own["target_dimension"]) == target
        if not going_on:
            s.append("embedding_schema", s.spark.createDataFrame([(*before, "migrating", *target)], TABLES["embedding_schema"]), v)
            facts = facts.withColumn("embedding_next", F.lit(None).cast("array<double>"))  # vectors staged for another target are void
        todo = lifecycle.pending_reembed(facts)
        todo = cut(todo.orderBy("fact_id").limit(batch) if batch else todo)
        staged = todo.withColumn("embedding_next", embedder(F.concat_ws("\n", "fact_type", "content", F.coalesce("quote", F.lit(""))))).where(F.size("embedding_next") == dimension)
        n = todo.count()
        s.append("fact", staged, v)
        left = lifecycle.pending_reembed(s.read("fact")).count()
        if left:
            return {"status": "migrating", "staged": n}
        s.append("fact", cut(lifecycle.cutover(s.read("fact"))), v + 1)
        s.append("embedding_schema", s.spark.createDataFrame([(*target, "ready", None, None, None)], TABLES["embedding_schema"]), v + 1)
        self._wrote()
        return {"status": "ready", "staged": n}

    def create_draft(self, draft_id: str, scope: str, items: DataFrame, now: dt.datetime, ttl: dt.timedelta = dt.timedelta(hours=24)) -> DataFrame:
        """Opens a draft with its items (item_id, item_type, payload, confidence, rationale, source_snippet), all
        pending. Creating it again changes nothing."""
        s, v = self.store, _micros(now)
        head = s.spark.createDataFrame([(draft_id, scope, "open", now, now + ttl, None)], TABLES["draft_ingestion"])
        s.insert("draft_ingestion", head, v)
        s.insert("draft_item", items.withColumns({"draft_id": F.lit(draft_id), "status": F.lit("pending")}), v)
        return lifecycle.draft_summary(s.read("draft_item").where(F.col("draft_id") == draft_id))

    def commit_draft(self, draft_id: str, now: dt.datetime) -> DataFrame:
        """Stores what was approved of a live draft, in order: its episode, entities, facts, edges; then communities
        are rebuilt and the draft is closed. One row of counts. A fact without text stops it before anything is
        stored. What names no valid time takes the draft's creation, so ids are those of an earlier run: run again after a
        failure, at any time, it stores only what is missing."""
        s, v = self.store, _micros(now)
        live = lifecycle.live_drafts(s.read("draft_ingestion"), now).where(F.col("draft_id") == draft_id).select("draft_id", "scope", "created_at")
        items = cut(s.read("draft_item").join(live, "draft_id"))
        head = live.first()
        if head is None:
            raise ValueError(f"no open draft: {draft_id}")
        made = head["created_at"]
        bad = [r["item_id"] for r in lifecycle.incomplete_items(items).limit(10).collect()]
        if bad:
            raise ValueError(f"facts without content: {', '.join(bad)}")
        get = lambda *names: F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names])
        approved = items.where(F.col("status").isin("approved", "edited"))
        named = approved.agg(F.min(get("draft_episode_id", "source_episode")).alias("id"), F.min_by(F.coalesce(get("source_text", "content"), "source_snippet"), F.struct(F.coalesce(get("source_text", "content"), "source_snippet").isNull(), "item_id")).alias("text"),
                             F.first("scope").alias("scope")).first()
        episode = named["id"]
        if episode is None and named["text"]:
            one = s.spark.createDataFrame([("draft_ingestion", draft_id, named["text"], made, named["scope"])], "source_type string, source_id string, content string, t_ref timestamp_ntz, scope string")
            got = self.ingest(one, now).first()
            episode = got["episode_id"] if got else None
        rows = {t: cut(df) for t, df in lifecycle.draft_rows(items.withColumn("source_episode", F.lit(episode).cast("string")), s.read("entity"), made, now).items()}
        s.insert("entity", rows["entity"], v)
        facts = self._with_names(rows["fact"].withColumn("index_keys", text.index_keys("content", "t_valid")), s.read("entity"))
        self._insert_facts(facts, v)
        self.relate(rows["edge"], now)
        self._update_communities(rows["edge"], now)
        s.append("draft_ingestion", s.read("draft_ingestion").where(F.col("draft_id") == draft_id).withColumn("status", F.lit("committed")), v + 1)
        self._wrote()
        return s.spark.createDataFrame([(draft_id, *(rows[t].count() for t in ("entity", "fact", "edge")), episode)], "draft_id string, entities long, facts long, edges long, source_episode string")

    def _rebuild_communities(self, now: dt.datetime, dry_run: bool = False) -> DataFrame:
        s, v = self.store, _micros(now)
        stored = s.read("community")
        labels = cut(graphs.components(s.read("edge").where(temporal.active_at(now))))
        fresh = graphs.communities_of(labels, s.read("entity")).withColumn("updated_at", temporal.ts(now))
        plan = cut(graphs.upsert_communities(stored, fresh))
        if not dry_run:
            s.delete("community", cut(stored.join(plan.select("community_id"), "community_id", "left_anti")), v)
            s.append("community", plan, v + 1)
            ComponentStore(s.spark, f"{s.path}/_components").replace(labels)
        return plan

    def _update_communities(self, added: DataFrame, now: dt.datetime) -> None:
        """Communities that the added edges touch, by stored labels; the others are not read. A new version of a triple
        links what the old one did; edges that run out by time leave at the next rebuild."""
        s, v = self.store, _micros(now)
        labels = ComponentStore(s.spark, f"{s.path}/_components")
        active = s.read("edge").where(temporal.active_at(now)).select("in_id", "out_id")
        known = labels._there("by_node")
        touched = labels.update(active, cut((added if known else active).select("in_id", "out_id")))
        fresh = graphs.communities_of(touched, s.read("entity")).withColumn("updated_at", temporal.ts(now))
        stored = s.read("community")
        plan = cut(graphs.upsert_communities(stored, fresh))
        s.delete("community", cut(graphs.overlapped_communities(stored, plan)), v)
        s.append("community", plan, v + 1)

    # -- reads --------------------------------------------------------------------------------------------
    def assemble_context(self, request: ContextRequest, now: dt.datetime | None = None) -> DataFrame:
        """The context; with a clock, its facts are logged as read. With a cache, a context that was asked for in
        the same way before comes from it until its scope is written to."""
        self._allow(now)
        s = self.store
        out = self._context(request)
        if self.cache is not None:
            out = s.spark.createDataFrame(self.cache.get(request, self._context), out.schema)
        if now is not None:
            self._log(out, lifecycle.RETRIEVE_BOOST, now)
        return out

    def _context(self, request: ContextRequest) -> DataFrame:
        s = self.store
        facts = lifecycle.apply_heat(s.read("fact", request.scope), s.read("access_log"))
        return assemble_context(MemoryTables(facts, s.read("episode", request.scope), s.read("entity"), s.read("edge"), s.read("community"), self.content_index, self.keys_index), request)

    def _log(self, rows: DataFrame, boost: int, now: dt.datetime) -> None:
        seen = rows.where("fact_id IS NOT NULL").select("fact_id", F.lit(boost).cast("long").alias("boost"), temporal.ts(now).alias("ts"))
        self.store.append("access_log", seen, _micros(now))

    def explain(self, fact_ids: list[str], now: dt.datetime | None = None) -> DataFrame:
        s = self.store
        sources = lifecycle.provenance(s.read("fact"), s.read("episode"), s.read("edge"))
        out = s.read("fact").where(F.col("fact_id").isin(*fact_ids)).select("fact_id", "content", "quote", "source_episode", temporal.simple_state().alias("state")).join(lifecycle.sources_array(sources), "fact_id", "left")
        if now is not None:
            self._log(out, lifecycle.EXPLAIN_BOOST, now)
        return out

    def open_session(self, app: str, scope: str, now: dt.datetime, **args) -> tuple[str, DataFrame]:
        """Opens an app in a session of a scope: its id and the first view. refresh_session() shows it again,
        close_session() ends it."""
        session = self.sessions.create(app, resolve_scope(scope, self.namespaces), args, now)
        return session.session_id, self.open_app(app, **({"now": now} | args))

    def refresh_session(self, session_id: str, now: dt.datetime, **changed) -> DataFrame:
        session = self.sessions.get(session_id, now)
        session.target = session.target | changed
        return self.open_app(session.app_id, **({"now": now} | session.target))

    def close_session(self, session_id: str) -> None:
        self.sessions.close(session_id)

    def act_in_session(self, session_id: str, action: str, now: dt.datetime, **args) -> DataFrame:
        self.sessions.get(session_id, now)
        return self.app_command(action, now, **args)

    def open_app(self, app: str, **args) -> DataFrame:
        """diff | graph | path | chain | edge | lifecycle | inspector | ingestion. lifecycle: args["view"] names one of
        the four lists of the console."""
        s = self.store
        if app == "path":
            found = graphs.shortest_path(s.read("edge"), args["source"], args["target"], args["as_of"], args.get("max_depth", 4), args.get("max_nodes", 500))
            steps = graphs.path_steps(s.read("edge"), s.read("entity"), found["path"], args["as_of"])
            whole = steps.agg(F.array_sort(F.collect_list(F.struct(*steps.columns))).alias("steps"))  # max_depth rows
            return whole.select(F.lit(found["status"]).alias("status"), F.array(*[F.lit(x) for x in found["path"]]).cast("array<string>").alias("path"), "steps").withColumn("context", F.to_json(F.struct("status", "path", "steps")))
        if app == "chain":
            return graphs.intro_chain(s.read("edge"), args["target"], args.get("max_hops", 3), args["as_of"])
        if app == "edge":
            return s.find("edge", args["edge_id"])
        if app == "diff":
            return lifecycle.temporal_diff(s.read("fact"), args["at_from"], args["at_to"], args.get("axis", "valid"), args.get("scope"), args.get("entity"), args.get("fact_type"))
        if app == "graph":
            start = s.spark.createDataFrame([(args["node"],)], "node string")
            return graphs.within_hops(s.read("edge").where(temporal.active_at(args["as_of"])), start, min(args.get("hops", 2), 2), args.get("direction", "outgoing"), 50)
        if app == "lifecycle":
            facts = lifecycle.apply_heat(s.read("fact", args.get("scope")), s.read("access_log"))
            return lifecycle.dashboard(facts, s.read("episode", args.get("scope")), s.read("community"), s.read("edge"), args["now"], args.get("half_life", 100.0), args.get("below", 0.5), args.get("least"), args.get("age_days", 90))[args.get("view", "low_confidence")]
        if app == "inspector":
            return self.inspect(args["record_id"], args["now"], args.get("page", 20))
        if app == "ingestion":
            return lifecycle.draft_summary(s.read("draft_item"))
        raise ValueError(f"unknown app: {app}")

    def inspect(self, record_id: str, now: dt.datetime, page: int = 20) -> DataFrame:
        """A record with what hangs on it, as one nested row; has_more tells that a page was full."""
        s, kind = self.store, record_id.split(":", 1)[0]
        own = s.find(kind, record_id)
        if kind == "entity":
            facts = s.read("fact").where(F.array_contains("entity_links", record_id))
            own = self._with_surroundings(own, record_id, now)
        elif kind == "episode":
            facts = s.read("fact").where(F.col("source_episode") == record_id)
        elif kind == "edge":
            return own.withColumn("state", F.when(temporal.active_at(now), "active").otherwise("closed"))
        elif kind == "community":
            members = relational.entities_by_ids(s.read("entity"), own.select(F.explode("member_entities").alias("entity_id")))
            return own.join(F.broadcast(members.agg(F.array_sort(F.collect_list("canonical_name")).alias("names"))))  # names of one community
        else:
            return own.withColumn("state", temporal.simple_state())
        top = facts.orderBy(F.col("confidence").desc(), "fact_id").limit(page).select("fact_id", "content", "confidence", temporal.simple_state().alias("state"))
        one = top.agg(F.sort_array(F.collect_list(F.struct("confidence", "fact_id", "content", "state")), False).alias("facts")).withColumn("has_more", F.size("facts") >= page)
        return own.join(F.broadcast(one))

    def _with_surroundings(self, own: DataFrame, entity_id: str, now: dt.datetime, page: int = 20) -> DataFrame:
        """An entity with its active edges in both directions (a page of each, by neighbour) and its communities."""
        s = self.store
        one = s.spark.createDataFrame([(entity_id,)], "node string")
        for direction in ("incoming", "outgoing"):
            near = graphs.neighbours(s.read("edge"), one, direction, now).orderBy("neighbour", F.col("t_valid").desc(), "edge_id").limit(page)
            near = near.agg(F.array_sort(F.collect_list(F.struct("neighbour", "relation", "edge_id", "strength", "confidence"))).alias(direction))  # a page
            own = own.join(F.broadcast(near))
        of = decode_communities(s.read("community")).where(F.array_contains("member_entities", entity_id)).orderBy("community_id").limit(page)
        return own.join(F.broadcast(of.agg(F.array_sort(F.collect_list(F.struct("community_id", "summary"))).alias("communities"))))

    def app_command(self, action: str, now: dt.datetime, dry_run: bool = True, confirmed: bool = False, **args) -> DataFrame:
        """archive | archive_episodes | restore | recompute_decay | rebuild_communities | approve | reject | edit | commit |
        cancel. Destructive lifecycle actions and commit need confirmed=True unless it is a dry run, which returns the
        plan; a real run appends it."""
        s, v = self.store, _micros(now)
        self._allow(now)
        if action in ("archive", "archive_episodes", "recompute_decay", "rebuild_communities", "commit") and not dry_run and not confirmed:
            raise ValueError("confirmed=True is needed")
        table = "episode"
        if action == "archive_episodes":
            chosen = s.read("episode").where(F.col("episode_id").isin(*args["episode_ids"]) & ~F.col("status").eqNullSafe(F.lit("archived")))
            plan = lifecycle.archive(chosen, now)
        elif action == "archive":
            plan = lifecycle.archive(lifecycle.archival_candidates(s.read("episode"), lifecycle.apply_heat(s.read("fact"), s.read("access_log")), now, args.get("age_days", 90)), now)
        elif action == "restore":
            plan = lifecycle.restore(s.read("episode").where(F.col("episode_id").isin(*args["episode_ids"])))
        elif action == "recompute_decay":
            table, plan = "fact", lifecycle.decay_pass(lifecycle.apply_heat(s.read("fact"), s.read("access_log")), now, args.get("threshold", 0.3), args.get("half_life", 100.0))
        elif action == "rebuild_communities":
            return self._rebuild_communities(now, dry_run)
        elif action in ("approve", "reject"):
            table, plan = "draft_item", lifecycle.review(s.read("draft_item"), args["item_ids"], action + ("d" if action == "approve" else "ed"))
        elif action == "edit":
            table, plan = "draft_item", lifecycle.edit(s.read("draft_item"), args["item_id"], args["payload"])
        elif action == "commit":
            if not dry_run:
                return self.commit_draft(args["draft_id"], now)
            return lifecycle.draft_commit_plan(s.read("draft_item").join(lifecycle.live_drafts(s.read("draft_ingestion"), now), "draft_id", "left_semi"))
        elif action == "cancel":
            plan = s.read("draft_ingestion").where(F.col("draft_id") == args["draft_id"])
            if not dry_run:
                s.delete("draft_ingestion", plan, v)
            return plan
        else:
            raise ValueError(f"unknown action: {action}")
        if not dry_run:
            plan = cut(plan)  # the plan as it was stored, whatever the table says afterwards
            s.append(table, plan, v)
            self._wrote()
        return plan

    def maintain(self, now: dt.datetime, threshold: float = 0.3, half_life: float = 100.0, age_days: float = 90) -> dict[str, int]:
        """One run of the periodic passes, decay first and then archival; a scheduler, or a stream's trigger, calls
        it. Returns the rows that each changed."""
        decayed = self.app_command("recompute_decay", now, False, True, threshold=threshold, half_life=half_life)
        archived = self.app_command("archive", now, False, True, age_days=age_days)
        return {"decayed": decayed.count(), "archived": archived.count()}
