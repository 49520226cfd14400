"""Mail decoding, keys, queue and wire formats."""

import base64
from pyspark.sql import functions as F

from mailsift.sources import mail

PLAIN = (b"From: Jane Doe <jane@example.com>\r\nSubject: Hello\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"
         b"Plain body\r\n")
MULTI = (b"From: jane@example.com\r\nSubject: Multi\r\nMIME-Version: 1.0\r\n"
         b"Content-Type: multipart/alternative; boundary=XX\r\n\r\n--XX\r\nContent-Type: text/plain\r\n\r\n"
         b"plain part\r\n--XX\r\nContent-Type: text/html\r\n\r\n<p>html part</p>\r\n--XX--\r\n")
HTML_ONLY = (b"From: a@b.c\r\nSubject: H\r\nContent-Type: text/html\r\n\r\n<p>only html</p>\r\n")
B64 = (b"From: a@b.c\r\nSubject: =?utf-8?b?" + base64.b64encode("Héllo Café ☕".encode()) + b"?=\r\n"
       b"Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"
       + base64.b64encode("Bødy ☕".encode()) + b"\r\n")
QP = (b"From: a@b.c\r\nSubject: QP\r\nContent-Type: text/plain; charset=utf-8\r\n"
      b"Content-Transfer-Encoding: quoted-printable\r\n\r\nCaf=C3=A9 au lait\r\n")
ATTACH = (b"From: a@b.c\r\nSubject: Att\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=YY\r\n\r\n"
          b"--YY\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n"
          b"Content-Transfer-Encoding: base64\r\n\r\nJVBERi0=\r\n--YY--\r\n")
NOHDR = b"\r\nno headers at all\r\n"


def parse(spark, raw):
    df = spark.createDataFrame([("p", raw)], "path string, content binary")
    r = mail.parse_mail(df).first()
    return r.from_address, r.subject, r.body


def test_parse_cases(spark):
    # line endings are kept as sent (the standard parser does not normalise them)
    assert parse(spark, PLAIN) == ("jane@example.com", "Hello", "Plain body\r\n")
    assert parse(spark, MULTI)[2] == "plain part"
    assert parse(spark, HTML_ONLY)[2] == "<p>only html</p>\r\n"
    assert parse(spark, B64)[1:] == ("Héllo Café ☕", "Bødy ☕")
    assert parse(spark, QP)[2] == "Café au lait\r\n"
    assert parse(spark, ATTACH)[2] == ""
    assert parse(spark, NOHDR)[:2] == ("", "")


def test_keys(spark):
    df = spark.createDataFrame([("raw-emails/2024/06/test-msg-002",), ("raw-emails/test%20msg%20003",),
                                ("raw-emails/a+b",), ("raw-emails/bad%zz",)], "k string")
    got = [tuple(r) for r in df.select(mail.key_to_id(F.col("k")).alias("x")).select("x.*").collect()]
    assert got == [("raw-emails/2024/06/test-msg-002", "test-msg-002"), ("raw-emails/test msg 003", "test msg 003"),
                   ("raw-emails/a b", "a b"), (None, None)]


def test_corpus_scan_and_job(spark, tmp_path):
    root = str(tmp_path / "bucket")
    rows = [("raw-emails/2024/m1", PLAIN), ("raw-emails/m2", B64),
            ("raw-emails/m3", PLAIN.replace(b"Subject: Hello", b"Subject: POISON-PILL demo"))]
    corpus = spark.createDataFrame(rows, "key string, content binary").withColumn(
        "received_ts", F.expr("TIMESTAMP_NTZ'2026-06-01 08:00:00'"))
    mail.write_corpus(corpus, root)
    raw = mail.read_corpus(spark, root)
    assert sorted(bytes(r.content) for r in raw.collect()) == sorted(c for _, c in rows)
    out = {r.email_id: r for r in mail.mail_job(raw).collect()}
    assert set(out) == {"m1", "m2", "m3"}
    assert out["m1"].raw_s3_key == "raw-emails/2024/m1" and out["m1"].received_at.endswith("+00:00")
    assert out["m3"].body is None and out["m1"].body == "Plain body\r\n"
    objects = tmp_path / "objects" / "2024"
    objects.mkdir(parents=True)
    for key, content in rows:
        (objects / key.rsplit("/", 1)[1]).write_bytes(content)
    flat = mail.raw_scan(spark, str(tmp_path / "objects"))  # one object per message
    assert sorted(bytes(r.content) for r in flat.collect()) == sorted(c for _, c in rows)
    assert flat.where("length <> octet_length(content)").count() == 0


def test_odd_messages(spark):
    rows = [(b"",), (None,), (b"From: a@x, b@y\r\n\r\nhi",), (b"From: undisclosed\r\nSubject: =?utf-8?b?w6k=?=\r\n\r\n",),
            (b"Content-Type: text/plain; charset=no-such-charset\r\n\r\n\xff\xfe",),
            (b"Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Disposition: attachment\r\n"
             b"Content-Type: text/plain\r\n\r\nfile\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>x</p>\r\n--B--\r\n",)]
    got = mail.parse_mail(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "path int, content binary"), ["path"])
    got = {r.path: r for r in got.collect()}
    assert (got[0].from_address, got[0].subject, got[0].body) == ("", "", "") and got[1].body == ""
    assert got[2].from_address == "a@x" and got[3].subject == "é" and got[5].body.strip() == "<p>x</p>"
    assert got[4].parse_error is not None or got[4].body is not None


def test_queue_roundtrip_absent_body(spark):
    df = spark.createDataFrame([("m1", "a@b", "s", "b", "k", "t"), ("m2", "a@b", "s", None, "k", "t")],
                               ", ".join(f"{c} string" for c in mail.QUEUE_FIELDS))
    enc = mail.queue_encode(df)
    values = {r.key: r.value for r in enc.collect()}
    assert '"body"' not in values["m2"] and '"body":"b"' in values["m1"]
    back = {r.email_id: r.body for r in mail.queue_decode(enc).collect()}
    assert back == {"m1": "b", "m2": None}


def test_wire_json(spark, tmp_path):
    line = ('{"email_id": {"S": "demo-email-001"}, "category": {"S": "feature_request"}, "urgency": {"S": "medium"},'
            ' "sentiment": {"S": "constructive"}, "feature_tags": {"L": [{"S": "dark-mode"}, {"S": "mobile-app"}]},'
            ' "review_status": {"S": "auto_processed"}, "received_at": {"S": "2026-06-20T09:00:00+00:00"}}')
    p = tmp_path / "seed.json"
    p.write_text(line + "\n")
    r = mail.wire_load(spark, str(p)).first()
    assert r.email_id == "demo-email-001" and r.feature_tags == ["dark-mode", "mobile-app"]
    again = mail.wire_decode(mail.wire_encode(mail.wire_load(spark, str(p)))).first()
    assert again == r
