"""Registered source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import mail, views
from .registry import flat, register


# The generated messages, written out: header lines, base64 of the subject on one line,
# base64 of the text in lines of 76 characters, CRLF after every line.
_LINES = r"regexp_replace(base64(encode(d.text)), '(.{76})', '\1' || chr(13) || chr(10), 'g')"


@register("raw_scan", f"""
SELECT key, CAST(length(content) AS BIGINT) AS length, md5(content) AS digest
FROM (SELECT m.raw_s3_key AS key,
             replace('From: "Sender, ' || d.source || '" <' || d.source || '@example.com>~'
               || 'Subject: =?utf-8?b?' || base64(encode(CASE WHEN m.doc_id % 50 = 13 THEN '[POISON-PILL] ' || m.subject
                                                              ELSE m.subject END)) || '?=~'
               || 'MIME-Version: 1.0~Content-Type: text/plain; charset=utf-8~Content-Transfer-Encoding: base64~~',
               '~', chr(13) || chr(10))
             || CASE WHEN length(base64(encode(d.text))) % 76 = 0 AND d.text <> ''
                     THEN left({_LINES}, length({_LINES}) - 2) ELSE {_LINES} END
             || chr(13) || chr(10) AS content
      FROM messages m JOIN documents d ON d.doc_id = m.doc_id)""", ("messages",))
def q_raw_scan(spark, sf_dir):
    """S1 over a packed corpus written from the documents: every byte is compared."""
    root = scratch_path(spark, "corpus")
    mail.write_corpus(views.mail_corpus(spark, sf_dir), root)
    got = mail.read_corpus(spark, root)
    return got.select("key", F.octet_length("content").cast("bigint").alias("length"), F.md5("content").alias("digest"))


@register("message_keys", """
SELECT 'raw-emails/' || (doc_id // 100) || '/msg+' || doc_id AS notification_key,
       'raw-emails/' || (doc_id // 100) || '/msg ' || doc_id AS key,
       'msg ' || doc_id AS email_id
FROM documents""")
def q_message_keys(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    enc = F.concat(F.lit("raw-emails/"), (F.col("doc_id") / 100).cast("long").cast("string"), F.lit("/"),
                   F.url_encode(F.concat(F.lit("msg "), F.col("doc_id"))))
    k = mail.key_to_id(enc)
    return d.select(enc.alias("notification_key"), k["key"].alias("key"), k["email_id"].alias("email_id"))


@register("mail_job", """
SELECT email_id, from_address,
       CASE WHEN doc_id % 50 = 13 THEN '[POISON-PILL] ' || subject ELSE subject END AS subject,
       CASE WHEN doc_id % 50 = 13 THEN NULL ELSE text END AS body,
       raw_s3_key, received_at, CAST(NULL AS VARCHAR) AS parse_error
FROM messages""", ("messages",))
def q_mail_job(spark, sf_dir):
    corpus = views.mail_corpus(spark, sf_dir).withColumnRenamed("key", "path")
    out = mail.mail_job(corpus, key_col=F.col("path"), received=F.col("received_ts"))
    return out.select("email_id", "from_address", "subject", "body", "raw_s3_key", "received_at", "parse_error")


_QUEUE = ", ".join(f"'{c}', {c}" for c in mail.QUEUE_FIELDS)
_QUEUE_NO_BODY = ", ".join(f"'{c}', {c}" for c in mail.QUEUE_FIELDS if c != "body")


@register("queue_encode", f"""
SELECT email_id AS key,
       CASE WHEN body IS NULL THEN json_object({_QUEUE_NO_BODY}) ELSE json_object({_QUEUE}) END::VARCHAR AS value
FROM messages""", ("messages",))
def q_queue_encode(spark, sf_dir):
    return mail.queue_encode(views.messages(spark, sf_dir))


@register("queue_decode", """
SELECT email_id, from_address, subject, body, raw_s3_key, received_at FROM messages""", ("messages",))
def q_queue_decode(spark, sf_dir):
    return mail.queue_decode(mail.queue_encode(views.messages(spark, sf_dir)))


@register("wire_json_load", """
SELECT email_id, category, urgency, sentiment, review_status, received_at,
       array_to_string(feature_tags, ',') AS feature_tags
FROM triage_history""", ("triage_history",))
def q_wire_json_load(spark, sf_dir):
    return flat(mail.wire_decode(mail.wire_encode(views.triage_history(spark, sf_dir))))
