"""Fixed values of the detectors and reports. They define the results and are not to be tuned."""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("info", "low", "medium", "high", "critical")
COVERAGE_RANK = {"not_applicable": 0, "complete": 0, "partial": 1, "unsupported": 2}
#: Findings of one artifact and of all, gaps, errors, and other default limits.
LIMITS = {
    "max_file_bytes": 50 * 1024 * 1024,
    "max_total_bytes": 1024 * 1024 * 1024,
    "max_files": 20_000,
    "max_directory_depth": 64,
    "max_text_bytes": 16 * 1024 * 1024,
    "max_findings_per_artifact": 1_000,
    "max_findings_total": 10_000,
    "max_archive_entries": 2_000,
    "max_archive_member_bytes": 32 * 1024 * 1024,
    "max_archive_expanded_bytes": 256 * 1024 * 1024,
    "max_archive_ratio": 200,
    "max_archive_depth": 3,
    "max_xml_bytes": 16 * 1024 * 1024,
    "max_pdf_pages": 500,
    "max_gaps_total": 10_000,
    "max_errors_total": 1_000,
    "max_report_bytes": 32 * 1024 * 1024,
    "max_name_bytes": 4 * 1024,
    "max_path_chars": 16 * 1024,
    "max_field_chars": 16 * 1024,
    "max_png_chunks": 4_096,
}

#: Gaps that are kept free to say that gaps, errors, fields or a whole report were cut (fixed value).
CONTROL_GAPS = 4

#: White space as the patterns mean it (Unicode, spelled out: Java's \\s is ASCII).
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    confidence: float
    value_class: str
    pattern: str
    #: A string of which a text must hold one for the pattern to be worth a try.
    needs: tuple[str, ...] = ()


#: The text rules, in Java's regular expressions (fixed values).
RULES = (
    Rule("pii.email", "pii", "high", 0.98, "email", r"(?iu)(?<![A-Za-z0-9.!#$%&'*+/=?^_`{|}~-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?){1,10}(?![A-Za-z0-9-])", ("@",)),
    Rule("pii.cn_mobile", "pii", "high", 0.98, "cn_mobile", r"(?<![0-9])(?:\+?86[ -]?)?1[3-9][0-9](?:[ -]?[0-9]){8}(?![0-9])"),
    Rule("pii.cn_resident_id", "pii", "critical", 0.99, "cn_resident_id", r"(?<![0-9A-Za-z])[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?![0-9A-Za-z])"),
    Rule("pii.bank_card", "pii", "critical", 0.98, "bank_card", r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])"),
    Rule("secret.pem_private_key", "secret", "critical", 1.0, "private_key", r"-----BEGIN (?<label>(?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY)-----[\s\S]{16,131072}?-----END \k<label>-----", ("PRIVATE KEY-----",)),
    Rule("secret.aws_access_key_id", "secret", "critical", 0.99, "secret", r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])", ("AKIA", "ASIA")),
    Rule("secret.github_token", "secret", "critical", 0.99, "secret", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{70,255})(?![A-Za-z0-9_])", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Rule("secret.openai_api_key", "secret", "critical", 0.99, "secret", r"(?<![A-Za-z0-9_-])sk-(?:(?:proj|svcacct)-)?[A-Za-z0-9_-]{20,512}(?![A-Za-z0-9_-])", ("sk-",)),
    Rule("secret.slack_token", "secret", "critical", 0.99, "secret", r"(?<![A-Za-z0-9-])xox[baprs]-[A-Za-z0-9-]{10,512}(?![A-Za-z0-9-])", ("xox",)),
    Rule("secret.google_api_key", "secret", "critical", 0.99, "secret", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", ("AIza",)),
    Rule("secret.jwt", "secret", "high", 0.95, "jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,4093}\.[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{8,4096}(?![A-Za-z0-9_-])", ("eyJ",)),
    Rule("privacy.windows_user_path", "path_disclosure", "medium", 0.95, "user_path", rf"(?iu)(?<![A-Za-z0-9:])(?:[A-Za-z]:[\\/]++(?:Users|Documents and Settings)[\\/]++|[\\/]{{2,}}+[^\\/{WS}!]++[\\/]++(?:Users|Documents and Settings)[\\/]++|(?:Users|Documents and Settings)[\\/]++)[^\\/{WS}!\"'<>|:]++(?:[\\/][^\\/{WS}!\"'<>|:]++)*+"),
    Rule("privacy.unix_user_path", "path_disclosure", "medium", 0.95, "user_path", rf"(?iu)(?<![A-Za-z0-9:/])(?:/++(?:home|Users)/++[^/{WS}!\"'<>]++(?:/++[^/{WS}!\"'<>]++)*+|/++root(?:/++[^/{WS}!\"'<>]++)++|/++mnt/++[a-z]/++(?:Users|Documents and Settings)/++[^/{WS}!\"'<>]++(?:/++[^/{WS}!\"'<>]++)*+|home/++[^/{WS}!\"'<>]++(?:/++[^/{WS}!\"'<>]++)*+)", ("/",)),
    Rule("unicode.bidi_control", "unicode_control", "high", 0.98, "unicode_control", r"[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"),
    Rule("unicode.zero_width", "unicode_control", "medium", 0.75, "unicode_control", r"[\u00ad\u200b-\u200d\u2060\ufeff]"),
)

#: Rules whose hit is the value of an assignment: groups are double-quoted, single-quoted and bare (fixed values).
ASSIGNMENTS = (
    Rule("secret.aws_secret_access_key", "secret", "critical", 0.99, "credential", rf"(?iu)[\"']?aws_secret_access_key[\"']?[{WS}]*(?:=|:)[{WS}]*(?:\"([A-Za-z0-9/+=]{{40}})\"|'([A-Za-z0-9/+=]{{40}})'|([A-Za-z0-9/+=]{{40}})(?![A-Za-z0-9/+=]))"),
    Rule("secret.credential_assignment", "secret", "high", 0.72, "credential", rf"(?iu)[\"']?\b(?:password|passwd|pwd|secret|token|api[-_]?key|access[-_]?key|client[-_]?secret|auth[-_]?token)\b[\"']?[ \t]*(?:=|:)[ \t]*(?:\"([^\"\r\n]{{4,256}})\"|'([^'\r\n]{{4,256}})'|([^{WS},;#\"']{{4,256}}))"),
)
#: Of the last rule: parts of values that are no secrets, and bare values after a colon that are types.
PLACEHOLDERS = ("changeme", "dummy", "example", "placeholder", "redacted", "replace", "sample", "yourpassword", "yourtoken")
TYPE_NAMES = ("any", "bool", "bytearray", "bytes", "float", "int", "memoryview", "none", "object", "path", "str", "typing.any")
TYPE_PATTERN = r"(?iu)^(?:typing\.)?(?:annotated|callable|dict|frozenset|iterable|list|literal|mapping|mutablemapping|optional|sequence|set|tuple|union)\[[a-z0-9_.,|\[\]]+\]?$"
#: Resident number: weights of its digits, and check characters by remainder.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"

ALL_RULES = RULES + ASSIGNMENTS

#: Parts of paths that name a person or a host, each with what takes its place (fixed values).
HOME_MASKS = (
    (r"(?iu)((?<![A-Za-z0-9:/\\])[\\/]{2,})[^\\/!\s]+([\\/]+(?:Users|Documents and Settings)[\\/]+)[^\\/!:\x00-\x1f]+", "$1<host>$2<user>"),
    (r"((?<![A-Za-z0-9:/\\])[\\/]{2,})[^\\/!\s]+([\\/]+)", "$1<host>$2"),
    (r"(?iu)((?<![A-Za-z0-9])(?:[A-Z]:[\\/]+(?:Users|Documents and Settings)[\\/]+))[^\\/!:\x00-\x1f]+", "$1<user>"),
    (r"(?iu)((?<![A-Za-z0-9:/])/+mnt/+[a-z]/+(?:Users|Documents and Settings)/+)[^/!\x00-\x1f]+", "$1<user>"),
    (r"((?<![A-Za-z0-9:/])/+(?:home|Users)/+)[^/!\x00-\x1f]+", "$1<user>"),
    (r"(?<![A-Za-z0-9:/])/+root(?=/|!|$)", "/<user>"),
    (r"(?iu)((?<![A-Za-z0-9])(?:home|Users|Documents and Settings)[\\/]+)[^\\/!:\x00-\x1f]+", "$1<user>"),
)

#: Names of files that are sensitive whatever they hold (fixed values).
SENSITIVE_NAMES = (".env", ".npmrc", ".pypirc", ".netrc", "credentials", "credentials.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "secrets.yml", "secrets.yaml", "service-account.json", "key.pem", "private.pem")
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx")
VCS_DIRECTORIES = (".git", ".hg", ".svn")

#: Structural rules of files and containers, and their severities.
STRUCTURAL_RULES = {
    "file.symlink": "high", "file.vcs_metadata": "high", "file.type_mismatch": "high", "file.sensitive_name": "high", "file.personal_name": "high", "file.executable": "high",
    "archive.comment": "low", "archive.path_traversal": "critical", "archive.duplicate_name": "medium", "archive.symlink": "high", "archive.encrypted": "high", "archive.entry_metadata": "low",
    "office.package_comment": "medium", "office.duplicate_part": "high", "office.symlink_part": "high", "office.part_comment": "medium", "office.encrypted_part": "high", "office.macro": "high", "office.digital_signature": "high", "office.comments": "high", "office.speaker_notes": "high", "office.custom_xml": "medium", "office.embedded_object": "high",
    "office.external_relationship": "high", "office.custom_properties": "medium", "office.tracked_changes": "high", "office.hidden_rows_columns": "high", "office.hidden_sheet": "high", "office.hidden_slide": "high", "office.external_data": "high",
    "office.core.creator": "medium", "office.core.last_modified_by": "medium", "office.core.title": "low", "office.core.subject": "low", "office.core.description": "medium", "office.core.keywords": "low", "office.core.category": "low", "office.core.identifier": "medium", "office.core.created": "low", "office.core.modified": "low", "office.core.last_printed": "medium", "office.core.revision": "low", "office.core.content_status": "low", "office.core.language": "low", "office.core.version": "low",
    "office.app.manager": "medium", "office.app.company": "medium", "office.app.hyperlink_base": "medium", "office.app.application": "low", "office.app.app_version": "low", "office.app.template": "low",
    "image.png_exif": "medium", "image.png_text": "medium", "image.png_ztxt": "medium", "image.png_itxt": "medium", "image.png_time": "low", "image.jpeg_exif": "medium", "image.jpeg_xmp": "medium", "image.jpeg_iptc": "medium", "image.jpeg_comment": "medium", "image.gps": "critical", "image.identity": "high", "image.device": "medium",
    "pdf.author": "medium", "pdf.creator": "medium", "pdf.producer": "low", "pdf.title": "low", "pdf.subject": "low", "pdf.keywords": "low", "pdf.xmp": "medium", "pdf.attachment": "high", "pdf.file_spec": "medium", "pdf.javascript": "high", "pdf.open_action": "high", "pdf.form": "medium", "pdf.annotation": "medium", "pdf.redaction_annotation": "high", "pdf.encrypted": "high",
}
