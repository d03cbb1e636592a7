"""The secret rule table: a JSON list of id, name, severity and regex."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlsift.functions.regex import rule_form


class Rule(NamedTuple):
    id: str
    name: str
    severity: str
    regex: str


# Public token formats as their vendors document them. The syntax is common to Java and RE2.
DEFAULT_RULES = [
    Rule("aws-access-key", "AWS Access Key ID", "critical", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    Rule("aws-secret-key", "AWS Secret Access Key", "critical", r"(?i)aws_?secret_?(?:access_?)?key['\"]?\s*[:=]\s*['\"]([A-Za-z0-9/+=]{40})['\"]"),
    Rule("aws-session-token", "AWS Session Token", "high", r"(?i)aws_?session_?token['\"]?\s*[:=]\s*['\"]([A-Za-z0-9/+=]{100,1000})['\"]"),
    Rule("aws-mws", "Amazon Marketplace Token", "high", r"amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    Rule("google-api-key", "Google API Key", "high", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("google-oauth-id", "Google OAuth Client ID", "low", r"[0-9]{8,20}-[0-9a-z]{32}\.apps\.googleusercontent\.com"),
    Rule("google-oauth-secret", "Google OAuth Client Secret", "high", r"GOCSPX-[0-9A-Za-z_-]{28}"),
    Rule("google-access-token", "Google Access Token", "high", r"ya29\.[0-9A-Za-z_-]{20,500}"),
    Rule("firebase-messaging", "Firebase Cloud Messaging Key", "high", r"AAAA[0-9A-Za-z_-]{7}:[0-9A-Za-z_-]{140}"),
    Rule("firebase-database", "Firebase Database URL", "low", r"https://[a-z0-9-]{3,60}\.firebaseio\.com"),
    Rule("github-pat", "GitHub Personal Access Token", "critical", r"ghp_[0-9A-Za-z]{36}"),
    Rule("github-oauth", "GitHub OAuth Token", "critical", r"gho_[0-9A-Za-z]{36}"),
    Rule("github-user", "GitHub User Token", "critical", r"ghu_[0-9A-Za-z]{36}"),
    Rule("github-server", "GitHub Server Token", "critical", r"ghs_[0-9A-Za-z]{36}"),
    Rule("github-refresh", "GitHub Refresh Token", "critical", r"ghr_[0-9A-Za-z]{36,80}"),
    Rule("github-fine-grained", "GitHub Fine-Grained Token", "critical", r"github_pat_[0-9A-Za-z]{22}_[0-9A-Za-z]{59}"),
    Rule("gitlab-pat", "GitLab Personal Access Token", "critical", r"glpat-[0-9A-Za-z_-]{20}"),
    Rule("gitlab-trigger", "GitLab Trigger Token", "high", r"glptt-[0-9a-f]{40}"),
    Rule("stripe-secret", "Stripe Secret Key", "critical", r"sk_live_[0-9A-Za-z]{24,99}"),
    Rule("stripe-restricted", "Stripe Restricted Key", "high", r"rk_live_[0-9A-Za-z]{24,99}"),
    Rule("stripe-publishable", "Stripe Publishable Key", "low", r"pk_live_[0-9A-Za-z]{24,99}"),
    Rule("stripe-test", "Stripe Test Key", "low", r"sk_test_[0-9A-Za-z]{24,99}"),
    Rule("stripe-webhook", "Stripe Webhook Secret", "high", r"whsec_[0-9A-Za-z]{32,64}"),
    Rule("square-access", "Square Access Token", "critical", r"sq0atp-[0-9A-Za-z_-]{22}"),
    Rule("square-secret", "Square OAuth Secret", "critical", r"sq0csp-[0-9A-Za-z_-]{43}"),
    Rule("braintree-token", "Braintree Access Token", "critical", r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}"),
    Rule("paypal-client", "PayPal Client Secret", "high", r"(?i)paypal_?(?:client_?)?secret['\"]?\s*[:=]\s*['\"]([0-9A-Za-z_-]{32,100})['\"]"),
    Rule("slack-bot", "Slack Bot Token", "critical", r"xoxb-[0-9]{8,14}-[0-9A-Za-z-]{16,80}"),
    Rule("slack-user", "Slack User Token", "critical", r"xox[pars]-[0-9A-Za-z-]{20,200}"),
    Rule("slack-app", "Slack App Token", "high", r"xapp-[0-9]-[0-9A-Z]{8,14}-[0-9]{8,14}-[0-9a-f]{40,80}"),
    Rule("slack-webhook", "Slack Webhook", "high", r"https://hooks\.slack\.com/services/T[0-9A-Z]{8,12}/B[0-9A-Z]{8,12}/[0-9A-Za-z]{24}"),
    Rule("discord-webhook", "Discord Webhook", "high", r"https://(?:ptb\.|canary\.)?discord(?:app)?\.com/api/webhooks/[0-9]{17,20}/[0-9A-Za-z_-]{60,80}"),
    Rule("discord-bot", "Discord Bot Token", "critical", r"\b([MNO][0-9A-Za-z_-]{23,25}\.[0-9A-Za-z_-]{6}\.[0-9A-Za-z_-]{27,38})\b"),
    Rule("telegram-bot", "Telegram Bot Token", "high", r"\b([0-9]{8,10}:AA[0-9A-Za-z_-]{33})\b"),
    Rule("twilio-account", "Twilio Account SID", "low", r"\b(AC[0-9a-f]{32})\b"),
    Rule("twilio-key", "Twilio API Key", "high", r"\b(SK[0-9a-f]{32})\b"),
    Rule("sendgrid", "SendGrid API Key", "critical", r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}"),
    Rule("mailgun", "Mailgun API Key", "high", r"\b(key-[0-9a-z]{32})\b"),
    Rule("mailchimp", "Mailchimp API Key", "high", r"\b([0-9a-f]{32}-us[0-9]{1,2})\b"),
    Rule("postmark", "Postmark Server Token", "high", r"(?i)x-postmark-server-token['\"]?\s*[:=,]\s*['\"]([0-9a-f-]{36})['\"]"),
    Rule("shopify-access", "Shopify Access Token", "critical", r"shpat_[0-9a-fA-F]{32}"),
    Rule("shopify-custom", "Shopify Custom App Token", "critical", r"shpca_[0-9a-fA-F]{32}"),
    Rule("shopify-private", "Shopify Private App Token", "critical", r"shppa_[0-9a-fA-F]{32}"),
    Rule("shopify-secret", "Shopify Shared Secret", "high", r"shpss_[0-9a-fA-F]{32}"),
    Rule("npm-token", "npm Access Token", "critical", r"npm_[0-9A-Za-z]{36}"),
    Rule("pypi-token", "PyPI Upload Token", "critical", r"pypi-AgEIcHlwaS5vcmc[0-9A-Za-z_-]{50,200}"),
    Rule("dockerhub-pat", "Docker Hub Token", "high", r"dckr_pat_[0-9A-Za-z_-]{27}"),
    Rule("digitalocean-pat", "DigitalOcean Token", "critical", r"dop_v1_[0-9a-f]{64}"),
    Rule("digitalocean-oauth", "DigitalOcean OAuth Token", "high", r"doo_v1_[0-9a-f]{64}"),
    Rule("heroku-key", "Heroku API Key", "high", r"(?i)heroku[a-z_]{0,20}key['\"]?\s*[:=]\s*['\"]([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})['\"]"),
    Rule("linear-key", "Linear API Key", "high", r"lin_api_[0-9A-Za-z]{40}"),
    Rule("notion-token", "Notion Integration Token", "high", r"\b(secret_[0-9A-Za-z]{43})\b"),
    Rule("sentry-dsn", "Sentry DSN", "low", r"https://[0-9a-f]{32}@[0-9a-z.]{1,60}\.ingest\.sentry\.io/[0-9]{1,20}"),
    Rule("mapbox-secret", "Mapbox Secret Token", "high", r"sk\.eyJ[0-9A-Za-z_-]{20,300}\.[0-9A-Za-z_-]{20,50}"),
    Rule("algolia-admin", "Algolia Admin Key", "high", r"(?i)algolia[a-z_]{0,20}key['\"]?\s*[:=]\s*['\"]([0-9a-f]{32})['\"]"),
    Rule("jwt", "JSON Web Token", "medium", r"eyJ[0-9A-Za-z_-]{10,500}\.eyJ[0-9A-Za-z_-]{10,900}\.[0-9A-Za-z_-]{10,500}"),
    Rule("private-key", "Private Key Block", "critical", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("basic-auth-url", "Credentials in URL", "high", r"https?://[0-9A-Za-z._~-]{1,60}:[^\s'\"`@/<>]{3,80}@[0-9A-Za-z.-]{3,100}"),
    Rule("bearer-token", "Bearer Token", "medium", r"(?i)bearer\s+([0-9a-z._~+/-]{20,400}=*)"),
    Rule("basic-auth-header", "Basic Authorization Header", "medium", r"(?i)authorization['\"]?\s*[:=]\s*['\"]basic\s+([0-9a-z+/]{12,200}=*)"),
    Rule("generic-token", "Generic Token Assignment", "medium", r"(?i)(?:token|secret|api_?key|access_?key|passwd|password)['\"]?\s*[:=]\s*['\"]([0-9a-z_./+=-]{12,200})['\"]"),
]


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON arrays; their order is that of file paths, then of places in a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    fields = "array<struct<id string, name string, severity string, regex string>>"
    rows = files.select("file", F.posexplode(F.from_json("value", fields)).alias("place", "rule"))
    # A rule table is a few hundred rows.
    order = F.row_number().over(Window.orderBy("file", "place"))
    return rows.select((order - 1).alias("rule_idx"), "rule.*")


def write_rules(spark: SparkSession, rules: list[Rule], path: str) -> None:
    """Add rules to a table as a JSON array in a file of its own, named so that later files come later."""
    n = spark.read.text(path, wholetext=True).count() if rules and _exists(spark, path) else 0
    array = json.dumps([r._asdict() for r in rules])
    spark.createDataFrame([(array,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rules={n:04d}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def usable_rules(spark: SparkSession, rules: list[Rule] | DataFrame | None = None) -> list[Rule]:
    """The rules whose pattern compiles; the others are skipped, as a scan must go on.

    ``rules`` is a list or a table as ``read_rules`` gives it.
    """
    if isinstance(rules, DataFrame):
        rules = [Rule(r.id, r.name, r.severity, r.regex) for r in rules.orderBy("rule_idx").collect() if r.regex is not None]
    rules = DEFAULT_RULES if rules is None else rules

    def compiles(some):
        try:
            probes = [F.rlike(F.lit(""), F.lit(rule_form(r.regex))).alias(f"r{i}") for i, r in enumerate(some)]
            spark.range(1).select(*probes).collect()
            return True
        except PySparkException:
            return False
        except Exception as error:  # a Java pattern error reaches Python unwrapped
            if "PatternSyntaxException" not in str(error):
                raise
            return False

    def split(some):
        if not some or compiles(some):
            return some
        if len(some) == 1:
            return []
        half = len(some) // 2
        return split(some[:half]) + split(some[half:])

    return split(list(rules))
