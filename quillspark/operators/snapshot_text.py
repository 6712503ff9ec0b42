"""A trade's indicator snapshot as five lines of Korean text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the lines.
FRAMES = {"daily": "일봉", "weekly": "주봉", "monthly": "월봉"}
ALIGNMENTS = {"bullish": "정배열", "bearish": "역배열", "mixed": "혼합", "partial": "일부", "unknown": "알수없음"}
PHASES = {"expanding": "밴드폭 확장", "squeeze": "밴드폭 수축", "neutral": "밴드폭 중립"}
PATTERNS = {"large_bullish": "장대양봉", "large_bearish": "장대음봉", "doji": "도지", "bullish": "양봉", "bearish": "음봉", "unknown": "알수없음"}


def _worded(c: Column, words: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), c)


def _frame(name: str) -> Column:
    sets = F.coalesce(F.col(name), F.array().cast("array<struct<k:int,values:struct<stoch_k:double,stoch_d:double,cross:string,direction:string,zone:string>>>"))
    total, rising = F.size(sets), F.size(F.filter(sets, lambda s: s["values"]["direction"] == "rising"))
    way = F.when(rising == total, "상승").when(rising == 0, "하락").otherwise("혼조")
    crossed = F.when(F.exists(sets, lambda s: s["values"]["cross"] == "golden"), " 골든크로스").when(F.exists(sets, lambda s: s["values"]["cross"] == "dead"), " 데드크로스").otherwise("")
    zoned = F.when(F.forall(sets, lambda s: s["values"]["zone"] == "overbought"), " (과매수)").when(F.forall(sets, lambda s: s["values"]["zone"] == "oversold"), " (과매도)").otherwise("")
    label = FRAMES[name]
    return F.when(total == 0, F.lit(f"{label} 데이터부족")).otherwise(F.concat(F.lit(f"{label} "), way, F.lit(" "), rising.cast("string"), F.lit("/"), total.cast("string"), crossed, zoned))


def _agreement() -> Column:
    told = [F.filter(F.coalesce(F.col(n), F.array().cast("array<struct<k:int,values:struct<stoch_k:double,stoch_d:double,cross:string,direction:string,zone:string>>>")), lambda s: s["values"]["stoch_k"].isNotNull()) for n in FRAMES]

    def all_go(way: str) -> Column:
        return reduce(lambda a, b: a & b, [F.forall(s, lambda x: x["values"]["direction"] == way) for s in told])

    return F.when(all_go("rising"), " → 방향 일치도 높음").when(all_go("falling"), " → 하락 일치도 높음").otherwise("")


def snapshot_text(snapshots: DataFrame) -> DataFrame:
    """The snapshots of ``trade_snapshots`` with ``text`` added."""
    deviation = F.col("ma.deviation20")
    averages = F.concat(
        F.lit("▸ 이평선: "),
        F.coalesce(_worded(F.col("ma.alignment"), ALIGNMENTS), F.lit("알수없음")),
        F.when(deviation.isNull(), "").otherwise(F.concat(F.lit(", 20일선 "), F.when(deviation >= 0, "지지").otherwise("저항"), F.lit(" (괴리율 "), F.when(deviation >= 0, "+").otherwise("-"), F.format_string("%.1f", F.abs(deviation)), F.lit("%)"))),
    )
    position = F.col("bb.position")
    place = F.when(position.isNull(), "알수없음").when(position > 1.0, "상단 돌파").when(position > 0.8, "상단 근접").when(position > 0.5, "중심선 상향").when(position > 0.2, "중심선 하향").when(position >= 0.0, "하단 근접").otherwise("하단 돌파")
    bands = F.concat(F.lit("▸ 볼린저: "), F.concat_ws(", ", place, _worded(F.col("bb.squeeze_expanding"), PHASES)))
    ratio = F.col("volume.volume_ratio")
    volume = F.when(ratio.isNull(), "▸ 거래량: 데이터부족").otherwise(F.concat(F.lit("▸ 거래량: 20일 평균 대비 "), F.bround(ratio * 100, 0).cast("bigint").cast("string"), F.lit("%")))
    shadow = F.col("candle.upper_shadow")
    candle = F.concat(
        F.lit("▸ 캔들: "),
        F.when(F.col("candle.gap") == "up", "갭 상승 후 ").when(F.col("candle.gap") == "down", "갭 하락 후 ").otherwise(""),
        F.coalesce(_worded(F.col("candle.pattern"), PATTERNS), F.col("candle.pattern")),
        F.lit(" 마감"),
        F.when(shadow < 0.1, ", 윗꼬리 짧음").when(shadow > 0.3, ", 윗꼬리 김").otherwise(""),
    )
    stochastics = F.concat(F.lit("▸ 스토캐스틱 정렬: "), F.concat_ws(" | ", *[_frame(n) for n in FRAMES]), _agreement())
    return snapshots.withColumn("text", F.concat_ws("\n", stochastics, averages, bands, volume, candle))
