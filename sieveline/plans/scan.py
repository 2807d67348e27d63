"""The whole scan as one plan: files to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.config import Config
from sieveline.functions import entropy as E
from sieveline.functions import paths
from sieveline.functions import strings as S
from sieveline.functions.plan import fixed, spread
from sieveline.operators import context, lines, match, plausible, resolve

# Words left of an assignment that raise or lower the threshold to 4, and words that a line with a harmless random
# token has.
CREDENTIALS = (
    "token secret password passwd pass pwd auth credential api_key apikey secret_key secretkey private_key privatekey access_key"
    " accesskey auth_key authkey app_key appkey master_key masterkey"
).split()
HASH_WORDS = "hash sha digest commit parent rev fingerprint checksum manifest".split()
CLIENT_WORDS = "client_id client-id clientid appid app_id".split()
CHECK_WORDS = "sha256sum sha512sum --sha256 --checksum checksum: integrity:".split()
DIGEST_FIELDS = ['"signature":', '"digest":', '"checksum":', '"fingerprint":']
DECODERS = ["hex.DecodeString(", "hex.Decode("]
API_FIELDS = ['"$ref":', '"operationId":']
NAMED = 4.0
LOG_THRESHOLD, LOG_LEAST = 4.5, 20
KEYS = ["file_path", "has_footer", "line_no"]


def prune(files: DataFrame, config: Config = Config(), path: str = "file_path", content: str = "content") -> DataFrame:  # noqa: B008
    """Files that are scanned: not excluded, not of a safe kind, not empty, not too large."""
    p, size = F.col(path), F.octet_length(F.col(content))
    return files.where(~paths.has_extension(p, config.exclude_extensions) & ~paths.excluded(p, config.exclude_paths) & ~paths.is_safe_file(p) & size.between(1, config.max_file_size_bytes))


def skipped(files: DataFrame, config: Config = Config(), path: str = "file_path", content: str = "content") -> DataFrame:  # noqa: B008
    """The files that prune leaves out, each with the first reason."""
    p, size = F.col(path), F.octet_length(F.col(content))
    reason = F.when(paths.has_extension(p, config.exclude_extensions), "extension").when(paths.excluded(p, config.exclude_paths), "path").when(paths.is_safe_file(p), "safe file").when(size == 0, "empty").when(size > config.max_file_size_bytes, "too large")
    return files.select(path, reason.alias("reason")).where(F.col("reason").isNotNull())


def lines_of(files: DataFrame, config: Config) -> DataFrame:
    """Scanned lines with what all passes need: the target, whether it is assigned, its compact form."""
    rows = lines.scanned(files.select("file_path", "content").withColumns({c: x for c, x in zip(("is_source", "is_netrc", "no_entropy", "is_test"), lines.file_flags(F.col("file_path")), strict=True)}), config.marker)
    # a line without quotes and signs of assignment is its own target, which spares most lines the search for one
    plain = F.lit(True)
    for c in "\"'`=:":
        plain = plain & ~F.contains("trim", F.lit(c))
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("assigned"))
    rows = fixed(rows, {"v_": F.when(plain, none).otherwise(S.secret_value(F.col("trim"), F.col("is_source")))})
    rows = fixed(rows, {"target": F.coalesce(S.strip(F.col("v_.value")), F.col("trim")), "assigned": F.col("v_.assigned")}).drop("v_")
    return fixed(rows, {"compact": S.compact(F.col("target"))})


def threshold(trim: Column, assigned: Column, default: float) -> Column:
    left = F.coalesce(*[F.when(trim.contains(op), trim.substr(F.lit(1), F.instr(trim, op) - 1)) for op in (":=", "=", ":")])
    return F.when(assigned & S.contains_any(F.lower(left), CREDENTIALS), F.lit(NAMED)).otherwise(F.lit(default))


def harmless(raw: Column, token: Column, kind: Column, compact: Column) -> dict[str, Column]:
    """Why a random token that nothing else speaks against is no secret, reason by reason."""
    low, is_hex = F.lower(raw), kind == "hex"
    before = raw.substr(F.instr(raw, token) - 1, F.lit(1))
    return {
        "mention": (F.instr(raw, token) > 1) & (before == "@"),
        "image_digest": is_hex & raw.contains("sha256:"),
        "named_hash": is_hex & F.length(token).isin(40, 64) & S.contains_any(low, HASH_WORDS),
        "client_id": is_hex & S.contains_any(low, CLIENT_WORDS),
        "checksum": is_hex & S.contains_any(low, CHECK_WORDS),
        "decoded_constant": is_hex & S.contains_any(raw, DECODERS),
        "dotted": (kind == "base64") & token.contains("."),
        "camel_case": (kind == "base64") & token.rlike(r"\A[A-Za-z._]*\z") & token.rlike("[A-Z]") & token.rlike("[a-z]{4}"),
        "decimal": is_hex & token.rlike(r"\A[0-9]*\z"),
        "kernel_path": F.startswith(compact, F.lit("/sys/")),
        "api_schema": S.contains_any(raw, API_FIELDS),
        "digest_field": is_hex & S.contains_any(low, DIGEST_FIELDS),
    }


def _classified(found: DataFrame, config: Config, sig: Column, with_previous: bool) -> DataFrame:
    if not config.context:
        return found
    path, raw, token = F.col("file_path"), F.col("raw"), F.col("token")
    found = fixed(found, {"name_": S.variable_name(raw, token)})
    checks = context.checks(path, raw, token, sig, F.col("name_"), F.col("is_test"))
    if with_previous:
        checks += context.previous_checks(raw, F.col("prev"), token, sig)
    return found.where(context.decide(checks)["decision"] == context.REAL).drop("name_")


def _allowed(found: DataFrame, config: Config) -> DataFrame:
    return found.where(~paths.matches_glob(F.col("token"), config.allowlist_patterns)) if config.allowlist_patterns else found


def searched(rows: DataFrame, config: Config) -> DataFrame:
    """A row for each text of a line that holds a prefix which may stand alone, with which and text: the line itself, or if it holds none its compact
    form, where that differs; and what the compact form decodes to."""
    sigs = config.all_signatures()
    rows = fixed(rows, {"low": F.lower("trim")})
    rows = fixed(rows, {"held": match.any_prefix(F.col("low"), sigs), "decoded": S.decoded(F.col("compact"))}).drop("low")
    differs = (F.length("compact") > 0) & (F.length("compact") < F.length("target"))
    # lower-cased only where they are looked at
    rows = fixed(rows, {"low_compact": F.when(~F.col("held") & differs, F.lower("compact")).otherwise(""), "low_decoded": F.coalesce(F.lower("decoded"), F.lit(""))})
    one = lambda which, text, holds: F.when(holds, F.struct(F.lit(which).alias("which"), F.col(text).alias("text")))
    texts = F.array(
        one(resolve.LINE, "trim", F.col("held") & (match.may_stand_alone(F.col("trim"), sigs) | match.any_joined_prefix(F.col("trim"), sigs))),
        one(resolve.COMPACT, "compact", match.any_prefix(F.col("low_compact"), sigs) & match.may_stand_alone(F.col("compact"), sigs)),
        one(resolve.DECODED, "decoded", match.any_prefix(F.col("low_decoded"), sigs) & match.may_stand_alone(F.col("decoded"), sigs)),
    )
    rows = rows.select("*", F.explode_outer(texts).alias("x")).where("x is not null")
    return rows.select("*", "x.*").drop("x", "low_compact", "low_decoded", "held", "decoded")


def pattern_pass(rows: DataFrame, config: Config) -> DataFrame:
    """Candidates of signatures in the texts of the lines."""
    some = match.occurrences(searched(rows, config), "text", config.all_signatures())
    which = F.col("which")
    free = (which == resolve.LINE) & F.startswith("sig.prefix", F.lit("_"))
    some = match.extract(some.where(free | match.stands_alone(F.col("text"), F.col("start"))), "text", "sig", "start", "stop").where("token != ''")
    token, sig = F.col("token"), F.col("sig.id")
    valid = (F.col("sig.validator") == "") | F.expr("rlike(token, sig.validator)")
    some = some.where(plausible.is_plausible(token, F.col("sig.prefix"), sig, config.min_secret_length) & valid & ~S.is_format_verb(token))
    some = _allowed(_classified(some, config, sig, False), config)
    return some.select(
        *KEYS,
        which.alias("pass"),
        F.col("seq"),
        S.clean_token(token).alias("token"),
        E.shannon(token).alias("entropy"),
        F.lit("PATTERN").alias("tier"),
        sig.alias("signature_id"),
        F.when(which == resolve.DECODED, F.concat("sig.description", F.lit(" (Base64 Decoded)"))).otherwise(F.col("sig.description")).alias("description"),
        F.col("sig.severity").alias("severity"),
        F.col("raw").alias("line_content"),
    )


def _random(found: DataFrame, which: int, prefix: str, text: str) -> DataFrame:
    label = F.concat(F.lit(prefix), F.col("kind"))
    return found.select(
        *KEYS,
        F.lit(which).alias("pass"),
        F.col("seq"),
        S.clean_token(F.col("token")).alias("token"),
        F.col("entropy"),
        F.lit("ENTROPY").alias("tier"),
        label.alias("signature_id"),
        F.format_string(text, F.upper("kind"), F.col("entropy")).alias("description"),
        E.severity(F.col("entropy")).alias("severity"),
        F.col("raw").alias("line_content"),
    )


def random_pass(rows: DataFrame, config: Config) -> DataFrame:
    """Candidates of random tokens in the compact form of targets without spaces."""
    least = config.min_secret_length
    some = rows.where(~F.col("no_entropy") & ~F.col("target").contains(" ") & (F.length("compact") >= least) & F.col("compact").rlike(rf"[{E.BASE64}]{{{least},}}"))
    some = some.select("*", F.posexplode(E.hits(F.col("compact"), threshold(F.col("trim"), F.col("assigned"), config.entropy_threshold), least)).alias("seq", "hit"))
    at = F.instr(F.col("hit.token"), "=")
    value = F.when((at > 0) & (at < F.length("hit.token") - 1), F.col("hit.token").substr(at + 1, F.length("hit.token"))).otherwise(F.col("hit.token"))
    some = fixed(some, {"token": value, "kind": F.col("hit.kind"), "entropy": F.col("hit.entropy")})
    some = _allowed(some, config)
    some = some.where(plausible.is_plausible(F.col("token"), F.lit(""), F.concat(F.lit("high-entropy-"), F.col("kind")), least))
    some = some.where(~(F.col("is_source") & ~F.col("assigned") & (F.col("kind") == "base64")))
    some = _classified(some, config, F.col("kind"), True)
    for reason in harmless(F.col("raw"), F.col("token"), F.col("kind"), F.col("compact")).values():
        some = some.where(~reason)
    return _random(some, resolve.RANDOM, "high-entropy-", "High-entropy %s string (entropy=%.2f)")


def log_pass(rows: DataFrame, config: Config) -> DataFrame:
    """Candidates among the words of lines of a log that show a bearer token or an authorization header."""
    least = max(LOG_LEAST, config.min_secret_length)
    some = rows.where(lines.is_log(F.col("trim"))).select("*", F.posexplode(F.split("trim", "[ \t\n\r]")).alias("word_at", "word"))
    some = some.withColumn("word", F.when(F.length("word") >= config.min_secret_length, S.clean_token(F.col("word")))).where(F.length("word") >= least)
    some = some.select("*", F.posexplode(E.hits(F.col("word"), F.lit(LOG_THRESHOLD), config.min_secret_length)).alias("hit_at", "hit"))
    some = fixed(some, {"token": F.col("hit.token"), "kind": F.col("hit.kind"), "entropy": F.col("hit.entropy"), "seq": F.col("word_at") * 4096 + F.col("hit_at")})
    some = _classified(_allowed(some, config), config, F.col("kind"), False)
    return _random(some, resolve.LOG, "log-high-entropy-", "High-entropy %s in log auth context (entropy=%.2f)")


def phrases(rows: DataFrame, config: Config) -> DataFrame:
    """Lines whose target is a recovery phrase, as findings; other passes don't see these lines."""
    found = rows.where(match.is_phrase(F.col("target"), config.phrase_words))
    if config.context:
        found = found.where(~F.col("is_test"))
    return found.select(*KEYS, F.lit(0).alias("place"), S.clean_token(F.col("target")).alias("token"), F.lit(0.0).alias("entropy"), F.lit("PATTERN").alias("tier"), F.lit("bip39-mnemonic").alias("signature_id"), F.lit("BIP-39 Crypto Recovery Seed").alias("description"), F.lit("CRITICAL").alias("severity"), F.col("raw").alias("line_content"))


def scan(files: DataFrame, config: Config = Config(), pruned: bool = False) -> DataFrame:  # noqa: B008
    """Findings of files (file_path, content): file_path, line_no, place, line_content, token, entropy, tier, signature_id, description,
    severity. Files are told apart by file_path.

    Lines are made and tested where a file is read; only candidates, a small share, are shuffled: once by line for the
    fold and once by file for blobs.
    """
    files = files if pruned else prune(files, config)
    files = files if files.isStreaming else spread(files)
    every = lines_of(files, config)
    extra = phrases(every, config) if config.phrase_words else None

    def rest(some: DataFrame) -> DataFrame:
        return some.where(~F.coalesce(match.is_phrase(F.col("target"), config.phrase_words), F.lit(False))) if config.phrase_words else some

    rows = rest(every)
    passes = []
    if config.patterns:
        passes.append(pattern_pass(rows, config))
    if config.entropy:
        # few files have lines of logs; for the others, and for files without an entropy pass, no lines are made here
        logs = rest(lines_of(files.where(lines.may_log(F.col("content"))), config))
        passes += [random_pass(rows, config), log_pass(logs, config)]
    if not passes:
        return _shape(extra if extra is not None else phrases(rows.where(F.lit(False)), config))
    both = passes[0]
    for p in passes[1:]:
        both = both.unionByName(p)
    found = resolve.per_line(both, KEYS)
    if extra is not None:
        found = found.unionByName(extra)
    found = resolve.drop_allowed(resolve.drop_headers(found), config.allowlist_patterns)
    return _shape(resolve.roll_up(found, ["file_path"]))


def _shape(found: DataFrame) -> DataFrame:
    return found.select("file_path", "line_no", "place", "line_content", "token", "entropy", "tier", "signature_id", "description", "severity")


def ledger(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a file, with or without findings: lines, findings, greatest entropy, worst severity."""
    own = findings.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_findings"), F.max("entropy").alias("max_entropy"), F.max_by("severity", resolve.weight(F.col("severity"))).alias("worst_severity"))
    each = files.select("file_path", F.size(lines.split_lines(F.col("content"))).cast("long").alias("n_lines"))
    return each.join(own, "file_path", "left").fillna(0, ["n_findings"])


def stop_at_first(findings: DataFrame) -> DataFrame:
    """The findings of the first file, by path, that has any."""
    return findings.join(findings.agg(F.min("file_path").alias("file_path")), "file_path", "left_semi")
