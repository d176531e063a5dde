"""Query-side bridge between Japanese and English terms, for one query or a frame of them.

All patterns are matched at once: the heads of a query's words are looked up among those that patterns begin with, and what
is found is compared in full. The glossary is a fixed table of some hundred rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import give_back, ranges
from .text import query_terms

#: Terms and the words they are linked with.
PAIRS: dict[str, tuple[str, ...]] = {
    "認証": ("auth", "authentication", "login", "signin", "credential"),
    "認可": ("authorization", "permission", "acl", "policy"),
    "権限": ("permission", "role", "privilege", "scope"),
    "ログイン": ("login", "signin", "authenticate"),
    "ログアウト": ("logout", "signout"),
    "パスワード": ("password", "passwd", "credential"),
    "トークン": ("token", "jwt", "bearer", "accesstoken"),
    "セッション": ("session", "cookie"),
    "暗号": ("encrypt", "crypto", "cipher", "encryption"),
    "署名": ("signature", "sign", "verify", "hmac"),
    "ハッシュ": ("hash", "digest", "bcrypt", "argon"),
    "有効期限": ("expiry", "expires", "ttl", "timeout", "deadline"),
    "更新": ("update", "refresh", "renew", "upsert"),
    "作成": ("create", "insert", "new", "register"),
    "削除": ("delete", "remove", "destroy", "purge"),
    "取得": ("get", "fetch", "retrieve", "read", "list", "find", "query"),
    "検索": ("search", "query", "find", "filter"),
    "一覧": ("list", "index", "all"),
    "決済": ("payment", "pay", "checkout", "charge", "billing"),
    "返金": ("refund", "reverse", "chargeback", "cancel"),
    "請求": ("invoice", "billing", "charge"),
    "注文": ("order", "purchase", "cart"),
    "在庫": ("stock", "inventory"),
    "顧客": ("customer", "user", "account", "client"),
    "利用者": ("user", "account"),
    "通知": ("notification", "notify", "alert", "push", "mail"),
    "メール": ("mail", "email", "smtp"),
    "リトライ": ("retry", "backoff", "attempt", "redrive"),
    "再試行": ("retry", "backoff", "attempt"),
    "タイムアウト": ("timeout", "deadline", "abort"),
    "例外": ("exception", "error", "throw", "raise"),
    "エラー": ("error", "exception", "failure", "fault"),
    "失敗": ("fail", "failure", "error"),
    "ログ": ("log", "logger", "logging", "trace"),
    "監視": ("monitor", "metrics", "observability", "alert"),
    "計測": ("metrics", "telemetry", "instrument"),
    "キャッシュ": ("cache", "memoize", "redis"),
    "キュー": ("queue", "sqs", "kafka", "worker", "job"),
    "非同期": ("async", "await", "background", "job"),
    "バッチ": ("batch", "cron", "scheduler", "job"),
    "並列": ("parallel", "concurrent", "concurrency"),
    "排他": ("lock", "mutex", "exclusive", "transaction"),
    "整合性": ("consistency", "integrity", "constraint"),
    "冪等": ("idempotent", "idempotency"),
    "検証": ("validate", "validation", "verify", "check"),
    "入力": ("input", "request", "payload", "param"),
    "出力": ("output", "response", "result"),
    "設定": ("config", "configuration", "setting", "env", "option"),
    "環境変数": ("env", "environment", "variable"),
    "依存": ("dependency", "depends", "import", "require"),
    "移行": ("migration", "migrate", "upgrade"),
    "スキーマ": ("schema", "model", "table", "column"),
    "データベース": ("database", "db", "sql", "table", "repository"),
    "テーブル": ("table", "entity", "model"),
    "接続": ("connection", "connect", "pool", "client"),
    "トランザクション": ("transaction", "commit", "rollback"),
    "インデックス": ("index",),
    "画面": ("page", "screen", "view", "component", "ui"),
    "画像": ("image", "file", "upload", "media"),
    "アップロード": ("upload", "multipart", "file"),
    "ダウンロード": ("download", "export"),
    "帳票": ("report", "pdf", "export"),
    "集計": ("aggregate", "sum", "count", "report"),
    "テスト": ("test", "spec", "assert", "mock"),
    "本番": ("production", "prod", "live"),
    "開発": ("development", "dev", "local"),
    "検証環境": ("staging", "stg", "qa"),
    "配信": ("deploy", "release", "delivery", "publish"),
    "公開": ("public", "expose", "publish"),
    "非公開": ("private", "internal"),
    "制限": ("limit", "throttle", "ratelimit", "quota"),
    "上限": ("max", "maximum", "limit", "cap"),
    "下限": ("min", "minimum"),
    "既定値": ("default", "fallback"),
    "仕様": ("spec", "specification", "requirement", "contract"),
    "要件": ("requirement", "spec"),
    "設計": ("design", "architecture"),
    "影響範囲": ("impact", "affected", "blast", "radius"),
    "脆弱性": ("vulnerability", "cve", "exploit"),
    "対策": ("mitigation", "remediation", "fix", "countermeasure"),
    "注入": ("injection", "inject", "sanitize", "escape"),
    "改ざん": ("tamper", "forgery", "integrity"),
    "なりすまし": ("spoof", "impersonate", "forgery"),
    "漏洩": ("leak", "exposure", "disclosure"),
    "再現": ("reproduce", "repro", "reproduction", "steps"),
    "原因": ("cause", "root", "cause", "reason"),
    "修正": ("fix", "patch", "repair"),
    "回避": ("workaround", "bypass"),
    "性能": ("performance", "latency", "throughput"),
    "遅延": ("latency", "delay", "slow"),
    "負荷": ("load", "stress", "traffic"),
    "分岐": ("branch", "condition", "if"),
    "状態": ("state", "status"),
    "遷移": ("transition", "workflow", "flow"),
    "webhook": ("ウェブフック", "通知", "コールバック"),
    "api": ("エンドポイント", "インタフェース"),
}
#: Weights of a term's words, of a word's terms, and of the pairs of characters in these.
LINKED, BACK, GRAM = 0.55, 0.5, 0.45
#: Fixed value: shorter words don't lead back to terms.
SHORTEST = 3
#: Bytes that no ASCII word holds, as blanks.
_BLANKS = bytes(b if chr(b).isascii() and (chr(b).isalnum() or b == 95) else 32 for b in range(256))


#: Terms by what leads back to them: ASCII words by their heads, others (right behind an ASCII word) as they are.
_HEADS: dict[str, list[tuple[str, str]]] = {}
_BEHIND: list[tuple[str, str]] = []
for _term, _linked in PAIRS.items():
    for _word in _linked:
        if len(_word) >= SHORTEST and _word.isascii():
            _HEADS.setdefault(_word[:SHORTEST], []).append((_word, _term))
        elif len(_word) >= SHORTEST:
            _BEHIND.append((_word, _term))
_ASCII_TERMS = frozenset(term for term in PAIRS if term.isascii())
_OTHER_TERMS = tuple(term for term in PAIRS if not term.isascii())
#: Runs of characters beyond Latin-1: all that Japanese terms and words are made of.
_WIDE = re.compile("[^\x00-\xff]+")


def _in_order(found: set[str]) -> list[str]:
    return [term for term in PAIRS if term in found] if found else []


def terms_in(query: str, words: set[str] | None = None) -> list[str]:
    """Terms that a query holds: Japanese ones anywhere, others as whole words."""
    found = _ASCII_TERMS & (_words_of(query.lower()) if words is None else words)
    wide = " ".join(_WIDE.findall(query))
    return _in_order({*found, *(term for term in _OTHER_TERMS if term in wide)} if wide else set(found))


def terms_of_words(query: str, words: set[str] | None = None) -> list[str]:
    """Terms that have a word which begins at either end of an ASCII word of the query."""
    low = query.lower()
    found = {term for own in (_words_of(low) if words is None else words) for word, term in _HEADS.get(own[:SHORTEST], ()) if own.startswith(word)}
    found.update(term for word, term in _BEHIND if word in low and re.search(f"[0-9a-z_]{word}", low))
    return _in_order(found)


def _words_of(low: str) -> set[str]:
    """ASCII words of a text in lower case."""
    return set(low.encode().translate(_BLANKS).decode().split())


def bridge_terms(query: str) -> dict[str, float]:
    """Terms that the glossary adds to a query, with weights below that of a word that is there.

    A pair of characters has its own weight even where it is a term by itself.
    """
    words = _words_of(query.lower())
    linked = dict.fromkeys((word for term in terms_in(query, words) for word in PAIRS[term]), LINKED)
    back = terms_of_words(query, words)
    pairs = dict.fromkeys((term[i : i + 2] for term in back for i in range(len(term) - 1)), GRAM)
    return dict.fromkeys(back, BACK) | linked | pairs


def weighted_terms(query: str, bridge: bool = True) -> dict[str, float]:
    """Query terms with their counts, then bridged terms that aren't among them."""
    own = query_terms(query)
    return own | {t: w for t, w in bridge_terms(query).items() if t not in own} if bridge else own


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n in ranges(batch.columns):
            part, terms, weights, sizes = batch.slice(at, n), [], [], []
            for text in part.column(1).to_pylist():
                found = weighted_terms(text or "")
                terms += found
                weights += found.values()
                sizes.append(len(found))
            ids = part.column(0).take(pa.array(np.repeat(np.arange(n), sizes)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(weights, pa.float64())], names=["query_id", "term", "weight"])
    give_back()


def weighted(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, term, weight: weighted_terms() of each row, in the task that reads its text; a null text has no terms.

    Nothing is shuffled unless rows share an id: then words are added up, and of what the glossary adds the last kind stays.
    """
    rows = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_weigh, f"query_id {rows.schema['query_id'].dataType.simpleString()}, term string, weight double")
    if rows.groupBy("query_id").count().where("count > 1").isEmpty():
        return found
    own = F.sum(F.when(F.col("weight") >= 1, F.col("weight")))  # what the glossary adds weighs less
    kind = F.array_position(F.array(F.lit(BACK), F.lit(LINKED), F.lit(GRAM)), F.col("weight"))
    return found.groupBy("query_id", "term").agg(F.coalesce(own, F.max_by("weight", kind)).alias("weight"))
