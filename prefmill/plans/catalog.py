"""The registered queries. Each reads the given tables whole.

Arrays are flattened to rows, joined strings or their md5, and doubles are rounded, so
results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.functions import chat
from prefmill.functions.derive import settle
from prefmill.functions.keys import dense_index, md5_int, row_count
from prefmill.functions.text import cut_at_stops, not_empty, strip, with_test_cases
from prefmill.functions.tokens import Vocabulary, split_tokens
from prefmill.operators import batching, filtering, metrics, pairing, scorecards, scoring, shift
from prefmill.operators.generation import (
    Patience, SamplingOptions, flaky, generate, generate_in_flight, replay, template_backend,
)
from prefmill.operators.sampling import (
    collect_samples, draw_with_replacement, expand_samples, pick_per_slot,
)
from prefmill.operators.cells import run_balanced
from prefmill.operators.verdict_table import VerdictTable
from prefmill.operators.verification import verdict_rows
from prefmill.plans import fixtures, stages
from prefmill.plans.fixtures import completed_instances, instances, table
from prefmill.session import materialise, scratch_path
from prefmill.sources import dialogues, jsonl

BATCH_SIZE = 8
SAMPLES = 3
EPOCHS = 3
SMALL_CELL = 1 << 14
GENERATED = 2  # verifiers, and completions, of each instance of ``generated_dataset``


def joined(array: Column | str, separator: str = ",") -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return F.array_join(array.cast("array<string>"), separator)


def rounded(*names: str) -> list[Column]:
    # adding 0.0 turns a rounded -0.0 into 0.0
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def seed_blob(spark: SparkSession) -> str:
    """The fixture seeds, written as a file and read back as one blob."""
    path = scratch_path(spark, "seeds")
    spark.createDataFrame([(fixtures.SEEDS,)], "value string").coalesce(1).write.text(path)
    return dialogues.read_seed_blob(spark, path)


# Sources


def hh_queries(spark: SparkSession, sf: str) -> DataFrame:
    return dialogues.delimited_queries(
        dialogues.delimited_openings(table(spark, sf, "conversations")), keep=("conv_id",)
    )


def first_message_queries(spark: SparkSession, sf: str) -> DataFrame:
    opened = dialogues.opening_turns(table(spark, sf, "conversations"))
    return opened.select("conv_id", F.col("text").alias("query")).filter(
        dialogues.length_in_range(F.col("query"))
    )


def message_list_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The list form: some lists are NULL, some empty, some open with an empty message."""
    opened = dialogues.opening_turns(table(spark, sf, "conversations"))
    empty = F.col("conv_id") % 13 == 0
    first = F.struct(F.col("role").alias("from"), F.when(~empty, F.col("text")).otherwise("").alias("value"))
    last = F.struct(F.lit("gpt").alias("from"), F.lit("a later message").alias("value"))
    messages = F.when(F.col("conv_id") % 17 == 0, F.slice(F.array(last), 1, 0)).otherwise(F.array(first, last))
    lists = opened.select("conv_id", F.when(F.col("conv_id") % 11 > 0, messages).alias("conversations"))
    return dialogues.message_queries(lists, keep=("conv_id",))


def sampled_queries(spark: SparkSession, sf: str) -> DataFrame:
    draws = table(spark, sf, "documents").select(F.col("doc_id").alias("instance_id"))
    return draw_with_replacement(first_message_queries(spark, sf), "conv_id", draws)


def merged_shards(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    prefix = scratch_path(spark, "turns")
    # One pass writes all shards, as folders side by side; a folder's name is no column of its rows.
    shard = F.pmod("conv_id", F.lit(3)).alias("shard")
    turns.select(shard, F.to_json(F.struct(*turns.columns), {"ignoreNullFields": "false"}).alias("value")).write.partitionBy(
        "shard"
    ).text(f"{prefix}-jsonl")
    merged = jsonl.merge_shards(spark, f"{prefix}-jsonl/shard", "", sign="=")
    return jsonl.read_jsonl(spark, merged, turns.schema)


# Prompts and generation


def clean_instructions(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "pages").select("page_id", F.explode(F.split("html", "[<>]")).alias("x"))
    # The unstripped text decides nothing: it is stripped first, then dropped if empty.
    cleaned = raw.select("page_id", strip(F.col("x")).alias("instruction"))
    return (
        cleaned.filter(not_empty(F.col("instruction")))
        .groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length("instruction")).alias("chars"),
             F.sum(md5_int(F.col("instruction")) % (1 << 40)).alias("checksum"),
             F.min("instruction").alias("least"), F.max("instruction").alias("greatest"))
    )


def instruction_prompts(spark: SparkSession, sf: str) -> DataFrame:
    drawn = sampled_queries(spark, sf)
    return drawn.select(
        "instance_id", chat.instruction_prompt(F.col("query"), seed_blob(spark)).alias("prompt")
    )


def verifier_prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompt = chat.verifier_prompt(F.col("query"), F.col("instruction"))
    return instances(spark, sf).select("instance_id", prompt.alias("prompt"))


def testcase_prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompt = chat.test_case_prompt(F.col("query"), F.col("instruction"), F.col("verifier"))
    return (
        instances(spark, sf)
        .select("instance_id", "query", "instruction",
                F.posexplode("verifiers").alias("verifier_pos", "verifier"))
        .select("instance_id", "verifier_pos", prompt.alias("prompt"))
    )


def completion_prompts(spark: SparkSession, sf: str) -> DataFrame:
    slots = expand_samples(instances(spark, sf), fixtures.NUM_COMPLETIONS, "slot")
    picked = pick_per_slot(
        F.col("verifiers"), F.size("verifiers"), 42, F.col("instance_id"), F.col("slot")
    )
    prompt = chat.completion_prompt(F.col("query"), F.col("instruction"), picked)
    return slots.select("instance_id", "slot", prompt.alias("prompt"))


def generated_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Generation through the Arrow path, with the deterministic backend."""
    prompt = chat.verifier_prompt(F.col("query"), F.col("instruction"))
    asked = instances(spark, sf).select(
        "instance_id", F.array_repeat(prompt, SAMPLES).alias("prompts")
    )
    backend = template_backend("Use at least {n} words.")
    made = generate(asked, backend, SamplingOptions(seed=42))
    return made.select("instance_id", F.posexplode("texts").alias("sample_idx", "text"))


def retried_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Many requests in flight to a backend that fails at first for every third instance."""
    prompt = chat.verifier_prompt(F.col("query"), F.col("instruction"))
    other = chat.completion_prompt(F.col("query"), F.col("instruction"), F.get("verifiers", 0))
    asked = instances(spark, sf).select("instance_id", F.array(prompt, other, prompt).alias("prompts"))
    backend = flaky(template_backend("Use at least {n} words."), lambda request: request.key % 3 == 0)
    made = generate_in_flight(
        asked, backend, SamplingOptions(seed=42), patience=Patience(attempts=2, wait=0.0), retries="retries"
    )
    return made.select("instance_id", "retries", F.posexplode("texts").alias("sample_idx", "text"))


def replayed_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded generations looked up by prompt, cut at stops, folded back per instance."""
    texts = table(spark, sf, "benchmark")
    prompts = table(spark, sf, "conversations").select("conv_id", "turn", "text").select(
        F.concat_ws(":", "conv_id", "turn").alias("prompt_id"),
        chat.ask(F.col("text")).alias("prompt"),
    )
    distinct = expand_samples(prompts.select(F.md5("prompt").alias("prompt_md5")).distinct(), SAMPLES)
    at = F.pmod(md5_int("replay", F.col("prompt_md5"), F.col("sample_idx")), row_count(texts))
    recorded = settle(distinct, {"idx": at}).join(
        dense_index(texts, "item_id", "replay", out="idx"), "idx"
    ).select("prompt_md5", "sample_idx", "text")
    # One slot in seven was never recorded.
    recorded = recorded.filter(md5_int("lost", F.col("prompt_md5"), F.col("sample_idx")) % 7 > 0)
    found = replay(expand_samples(prompts, SAMPLES), recorded, spread="prompt_id", missing="null")
    cut = found.withColumn("text", cut_at_stops(F.col("text"), ["\n", ". ", ","]))
    folded = collect_samples(cut, "prompt_id", count=SAMPLES)
    return folded.select("prompt_id", F.array_join("texts", "|", "<missing>").alias("texts"))


def generated_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The three generating stages in a row, over as many instances as conversations."""
    backend = template_backend("Use at least {n} words.")
    drawn = table(spark, sf, "conversations").select(F.col("conv_id").alias("instance_id")).distinct()
    asked = stages.build_instructions(
        first_message_queries(spark, sf), "conv_id", fixtures.SEEDS, drawn, backend
    )
    instructions = materialise(asked, "instructions")
    artifacts = materialise(stages.build_artifacts(instructions, GENERATED, backend), "artifacts")
    done = stages.build_completions(artifacts, GENERATED, backend)
    return done.select(
        "instance_id", "instruction", F.md5(joined("verifiers", "|")).alias("verifiers_md5"),
        F.md5(joined("testcases", "|")).alias("testcases_md5"), joined("completions", "|").alias("completions"),
    )


# Self-consistency


def parsed_test_cases(spark: SparkSession, sf: str) -> DataFrame:
    return (
        with_test_cases(instances(spark, sf), F.col("testcases"))
        .select("instance_id", F.posexplode("cases").alias("case_pos", "c"))
        .select("instance_id", "case_pos", "c.response", "c.result")
    )


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return filtering.judge_test_cases(instances(spark, sf, spread_out=True), allow_execution=True)


def weighed(spark: SparkSession, sf: str) -> DataFrame:
    return filtering.weigh(judged(spark, sf))


def verdict_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return verdict_rows(judged(spark, sf), "instance_id").drop("timeout")


def kept_test_cases(spark: SparkSession, sf: str) -> DataFrame:
    return (
        weighed(spark, sf)
        .select("instance_id", F.explode("kept_cases").alias("c"))
        .select("instance_id", F.col("c.pos").alias("case_pos"), "c.response", "c.result")
    )


def verifier_pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    return (
        weighed(spark, sf)
        .filter(F.size("kept_cases") > 0)
        .select("instance_id", F.size("kept_cases").alias("cases"),
                F.explode("rated_verifiers").alias("v"))
        .select("instance_id", F.col("v.pos").alias("verifier_pos"), "v.passed", "cases",
                (F.col("v.passed") * 5 >= F.col("cases") * 4).alias("kept"))
    )


def filtered_instances(spark: SparkSession, sf: str) -> DataFrame:
    cases = F.transform(
        "test_cases", lambda c: F.concat_ws("=", c["response"], c["result"].cast("string"))
    )
    return filtering.filtered_instances(weighed(spark, sf)).select(
        "instance_id", "query", "instruction", joined("verifiers", "|").alias("verifiers"),
        joined(cases, "|").alias("test_cases"), "verifiers_pass_80pct", "total_passes",
    )


def stored_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered instances written as JSON lines and read back."""
    path = scratch_path(spark, "filtered")
    jsonl.write_jsonl(filtering.filtered_instances(weighed(spark, sf)), path)
    back = jsonl.read_jsonl(spark, path, jsonl.FILTERED)
    return back.select("instance_id", F.posexplode("test_cases").alias("pos", "c"), "total_passes").select(
        "instance_id", "pos", "c.response", "c.result", "total_passes"
    )


def instance_counters(spark: SparkSession, sf: str) -> DataFrame:
    return weighed(spark, sf).select("instance_id", *jsonl.COUNTERS)


def filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return filtering.funnel(weighed(spark, sf))


def stage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel as the job that writes the instances counts it, and how many it wrote."""
    run = stages.run_filter(instances(spark, sf, spread_out=True), allow_execution=True)
    totals = [F.lit(run.totals[c]).cast("bigint").alias(c) for c in (*jsonl.COUNTERS, "finished", "timed_out", "unfinished")]
    return run.rows.agg(F.count(F.lit(1)).alias("written"), F.count_if("kept").alias("kept")).select(*totals, "written", "kept")


def verdict_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """The test cases judged twice with one table: what each run finds known."""
    known = VerdictTable(spark, scratch_path(spark, "verdicts"))
    cases = with_test_cases(instances(spark, sf), F.col("testcases"))
    rows = []
    for run in range(2):
        _, reuse = known.judge(
            cases, F.col("verifiers"), F.col("cases.response"), allow_execution=True, partitions=shuffle_partitions(spark)
        )
        rows.append((run, reuse.cells, reuse.distinct, reuse.judged, known.rows().filter("text_key <> ''").count()))
    return spark.createDataFrame(rows, "run int, cells bigint, distinct_pairs bigint, judged bigint, known bigint")


# Scoring and pairs


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def completion_flags(judged: DataFrame) -> DataFrame:
    rows = verdict_rows(judged, "instance_id")
    return rows.select("instance_id", "verifier_pos", "compiled", "input_pos", "truthy", "error")


def balanced_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Completions judged in cells of a few texts, dealt out by cost."""
    completed = completed_instances(spark, sf)
    return completion_flags(run_balanced(
        completed, F.col("verifiers"), F.col("completions"), shuffle_partitions(spark), allow_execution=True, cell_cost=SMALL_CELL
    ))


def table_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Completions judged by way of a verdict table that knows the verdicts on the test cases."""
    known = VerdictTable(spark, scratch_path(spark, "verdicts"))
    cases = with_test_cases(instances(spark, sf), F.col("testcases"))
    partitions = shuffle_partitions(spark)
    known.judge(cases, F.col("verifiers"), F.col("cases.response"), allow_execution=True, partitions=partitions)
    judged, _ = known.judge(
        completed_instances(spark, sf), F.col("verifiers"), F.col("completions"), allow_execution=True, partitions=partitions
    )
    return completion_flags(judged)


def judged_completions(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.judge_completions(completed_instances(spark, sf), allow_execution=True)


def scored(spark: SparkSession, sf: str, *outputs: str) -> DataFrame:
    return scoring.score(judged_completions(spark, sf), outputs)


def completion_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return completion_flags(judged_completions(spark, sf))


def completion_scores(spark: SparkSession, sf: str) -> DataFrame:
    rates = scored(spark, sf, "rates")
    return rates.select("instance_id", F.posexplode("rates").alias("slot", "rate"))


def labelled_completions(spark: SparkSession, sf: str) -> DataFrame:
    done = scored(spark, sf, "chosen", "rejected")
    sides = [
        F.struct(F.lit(side).alias("label"), F.col(side).alias("texts"))
        for side in ("chosen", "rejected")
    ]
    return (
        done.select("instance_id", F.inline(F.array(*sides)))
        .select("instance_id", "label", F.posexplode("texts").alias("pos", "completion"))
    )


def score_map(spark: SparkSession, sf: str) -> DataFrame:
    return (
        scored(spark, sf, "scores")
        .select("instance_id", F.posexplode("scores").alias("pos", "s"))
        .select("instance_id", "pos", "s.completion", "s.score")
    )


def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored instances written as JSON lines and read back."""
    path = scratch_path(spark, "scored")
    jsonl.write_jsonl(scoring.scored_rows(scored(spark, sf, "chosen", "rejected", "scores")), path)
    back = jsonl.read_jsonl(spark, path, jsonl.SCORED)
    return back.select("instance_id", F.explode("scores").alias("s")).select(
        "instance_id", F.md5("s.completion").alias("completion_md5"), "s.score"
    )


def yield_report(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.yield_report(scored(spark, sf, "chosen", "rejected"))


def relabelled(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds that overlap: at or above 0.25 chosen, below 0.5 rejected."""
    done = pairing.relabel(scored(spark, sf, "scores"), 0.25, 0.5)
    return done.select(
        "instance_id", F.md5(joined("chosen", "|")).alias("chosen_md5"),
        F.md5(joined("rejected", "|")).alias("rejected_md5"),
        F.size("chosen").alias("n_chosen"), F.size("rejected").alias("n_rejected"),
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.preference_pairs(scored(spark, sf, "scores"))


def bounded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each completion of the shorter list is used twice at most."""
    return pairing.preference_pairs(scored(spark, sf, "scores"), max_loop=2)


def self_consistent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All stages in a row: filter instances, then score and pair with kept verifiers."""
    kept = filtering.filtered_instances(weighed(spark, sf)).select(
        F.col("instance_id").alias("conv_id"), "query", "instruction", "verifiers"
    )
    completed = kept.join(fixtures.drawn_completions(spark, sf), "conv_id")
    judged = scoring.judge_completions(completed, allow_execution=True)
    return pairing.preference_pairs(scoring.score(judged, ("scores",)))


# Training batches and metrics


def token_views(spark: SparkSession, sf: str) -> DataFrame:
    views = batching.token_views(pairs(spark, sf))
    return views.select(
        "instance_id", "pair_idx",
        *[F.md5(joined(f"input_ids_{v}")).alias(f"ids_md5_{v}") for v in batching.VIEWS],
        *[metrics.mask_sum(F.col(f"attention_mask_{v}")).alias(f"len_{v}") for v in batching.VIEWS],
        metrics.completion_length(
            F.col("attention_mask_chosen"), F.col("attention_mask_context")
        ).alias("completion_len_chosen"),
    )


def vocabulary_views(spark: SparkSession, sf: str) -> DataFrame:
    """Token views with a public vocabulary, and the texts that the ids spell."""
    import public_tokenizers

    style = chat.ChatStyle()
    marks = (style.begin, style.role_open, style.role_close.rstrip("\n"), style.turn_end)
    vocabulary = Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, marks)
    views = batching.token_views(pairs(spark, sf), vocabulary.tokenizer(), style)
    return views.select(
        "instance_id", "pair_idx",
        *[F.md5(vocabulary.text(F.col(f"input_ids_{v}"))).alias(f"text_md5_{v}") for v in batching.VIEWS],
        *[(F.size(F.filter(f"input_ids_{v}", lambda i: i == vocabulary.marks[style.turn_end]))).alias(f"turns_{v}") for v in batching.VIEWS],
        *[(F.array_max(f"input_ids_{v}") < len(vocabulary)).alias(f"known_{v}") for v in batching.VIEWS],
    )


def padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    written = materialise(pairs(spark, sf), "pairs")
    batched = batching.shuffled_batches(written, BATCH_SIZE)
    padded = batching.pad_batches(batching.token_views(batched))
    return padded.select(
        "instance_id", "pair_idx", "batch_id", "batch_pos",
        *[F.md5(joined(f"input_ids_{v}")).alias(f"ids_md5_{v}") for v in batching.VIEWS],
        *[F.array_position(f"attention_mask_{v}", 1).alias(f"starts_{v}") for v in batching.VIEWS],
        *[metrics.mask_sum(F.col(f"attention_mask_{v}")).alias(f"len_{v}") for v in batching.VIEWS],
        *[F.size(f"input_ids_{v}").alias(f"padded_{v}") for v in batching.VIEWS],
    )


def epoch_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Three epochs of the preference pairs."""
    written = materialise(pairs(spark, sf).select("instance_id", "pair_idx"), "pair-keys")
    return batching.epoch_batches(written, BATCH_SIZE, EPOCHS)


def logprobs(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in log-probabilities: the four quarters of each vector."""
    vector, quarter = F.col("embedding").cast("array<double>"), F.expr("size(embedding) div 4").cast("int")
    names = ("pi_chosen", "pi_rejected", "ref_chosen", "ref_rejected")
    return table(spark, sf, "embeddings").select(
        F.expr(f"vec_id div {BATCH_SIZE}").alias("batch_id"),
        *[F.slice(vector, quarter * i + 1, quarter).alias(name) for i, name in enumerate(names)],
        F.pmod("vec_id", quarter + 2).cast("int").alias("len_chosen"),
        F.pmod(F.col("vec_id") * 7, quarter + 2).cast("int").alias("len_rejected"),
    )


def dpo_metrics(spark: SparkSession, sf: str) -> DataFrame:
    report = metrics.preference_metrics(metrics.completion_sums(logprobs(spark, sf)))
    return report.select("batch_id", *rounded(*[c for c in report.columns if c != "batch_id"]))


def dpo_metrics_nll(spark: SparkSession, sf: str) -> DataFrame:
    sums = metrics.completion_sums(logprobs(spark, sf))
    report = metrics.preference_metrics(sums, kl_beta=1.0, include_chosen_nll_loss=True)
    return report.select("batch_id", *rounded("dpo_loss", "chosen_nll_loss", "loss"))


def shift_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a one-message chat, with made-up log-probabilities per position."""
    turns = fixtures.spread(table(spark, sf, "conversations"), "conv_id", "turn")
    text = chat.render_chat(F.array(F.struct("role", F.col("text").alias("content"))))
    marked = F.transform(
        split_tokens(F.col("text")),
        lambda t, i: F.when((i % 2 == 0) & ~t.startswith("<|"), F.concat(F.lit("Ġ"), t)).otherwise(t),
    )

    def lp(step: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size("tokens") - 2),
            lambda i: -F.pmod(F.col("conv_id") * 31 + F.col("turn") * 17 + i * step, F.lit(3000))
            / F.lit(1000.0),
        )

    rows = settle(turns.select("conv_id", "turn", text.alias("text")), {"tokens": marked}).drop("text")
    return shift.token_shift_scores(rows.withColumns({"model_lp": lp(7919), "ref_lp": lp(104729)}))


def token_shift_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = shift_scores(spark, sf)
    return scores.select(
        "conv_id", "turn", F.md5(joined("tokens", " ")).alias("tokens_md5"),
        F.size("scores").alias("n"),
        (F.round(F.aggregate("scores", F.lit(0.0), lambda a, s: a + s), 6) + F.lit(0.0)).alias("total"),
        F.size(F.filter("scores", lambda s: s == 1)).alias("clipped_up"),
    )


def token_shift_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = shift.token_shift_table(shift_scores(spark, sf), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "pos", "token", *rounded("score"), "direction")


def token_shift_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = shift.token_shift_table(shift_scores(spark, sf), ["conv_id", "turn"])
    # Means with a power-of-two count end in exact halves, which engines round either
    # way; the mean times the count does not.
    total = F.round(F.col("avg_score") * F.col("n"), 6) + F.lit(0.0)
    return shift.token_shift_rollup(rows).select("token", total.alias("total_score"), "n")


# Scorecards


def flag_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.floor(F.col("doc_id") / 3).alias("prompt_id"),
        (F.col("quality") == 1).alias("strict"),
        ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("loose"),
    )


def choice_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    item = F.floor(F.col("doc_id") / 4)
    return table(spark, sf, "documents").select(
        item.alias("item_id"), F.pmod("doc_id", F.lit(4)).alias("option"),
        (-F.pmod(md5_int("ll", F.col("doc_id")), F.lit(100000)) / F.lit(100.0)).alias("ll"),
        F.col("text").alias("option_text"),
        F.pmod(md5_int("gold", item), F.lit(4)).alias("gold"),
    )


def if_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    card = scorecards.scorecard("ifeval", flag_outcomes(spark, sf))
    return card.select(*rounded(*card.columns))


def choice_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    card = scorecards.scorecard("hellaswag", choice_outcomes(spark, sf))
    return card.select(*rounded(*card.columns))


def limited_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """The row limit is the feature here: the first 25 items only."""
    card = scorecards.scorecard("hellaswag", choice_outcomes(spark, sf), limit=25)
    return card.select(*rounded(*card.columns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hh_queries": hh_queries,
    "first_message_queries": first_message_queries,
    "message_list_queries": message_list_queries,
    "sampled_queries": sampled_queries,
    "merged_shards": merged_shards,
    "clean_instructions": clean_instructions,
    "instruction_prompts": instruction_prompts,
    "verifier_prompts": verifier_prompts,
    "testcase_prompts": testcase_prompts,
    "completion_prompts": completion_prompts,
    "generated_texts": generated_texts,
    "retried_generations": retried_generations,
    "replayed_generations": replayed_generations,
    "generated_dataset": generated_dataset,
    "parsed_test_cases": parsed_test_cases,
    "verdict_matrix": verdict_matrix,
    "kept_test_cases": kept_test_cases,
    "verifier_pass_rates": verifier_pass_rates,
    "filtered_instances": filtered_instances,
    "stored_instances": stored_instances,
    "instance_counters": instance_counters,
    "filter_funnel": filter_funnel,
    "stage_totals": stage_totals,
    "verdict_reuse": verdict_reuse,
    "completion_verdicts": completion_verdicts,
    "balanced_verdicts": balanced_verdicts,
    "table_verdicts": table_verdicts,
    "completion_scores": completion_scores,
    "labelled_completions": labelled_completions,
    "score_map": score_map,
    "stored_scores": stored_scores,
    "yield_report": yield_report,
    "relabelled": relabelled,
    "preference_pairs": pairs,
    "bounded_pairs": bounded_pairs,
    "self_consistent_pairs": self_consistent_pairs,
    "token_views": token_views,
    "vocabulary_views": vocabulary_views,
    "padded_batches": padded_batches,
    "epoch_batches": epoch_batches,
    "dpo_metrics": dpo_metrics,
    "dpo_metrics_nll": dpo_metrics_nll,
    "token_shift_scores": token_shift_scores,
    "token_shift_table": token_shift_table,
    "token_shift_rollup": token_shift_rollup,
    "if_scorecard": if_scorecard,
    "choice_scorecard": choice_scorecard,
    "limited_scorecard": limited_scorecard,
}
