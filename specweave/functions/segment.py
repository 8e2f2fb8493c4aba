"""Segmentation of Chinese runs: a provider, with a lexicon as the offline default.

The default matches the longest lexicon word at each place and also gives the
shorter lexicon words within it, before it, as a search segmenter does.
Characters in no word are tokens of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the domain.
LEXICON = """
电源 适配器 电源适配器 开关 开关电源 充电器 锂电池 电池 电池组 电池包 可充电 驱动 驱动电源 恒流 恒流驱动 直流 电机 马达 直流电机
无刷 有刷 步进 步进电机 磷酸铁锂 三元锂 锂离子 聚合物锂 锂聚合物 美规 欧规 英规 澳规 国标 中规 美标 欧标 英标 澳标 插头 认证
输出 输入 电压 电流 输出电压 输出电流 输入电压 额定 标称 功率 容量 毫安时 毫安 公斤 重量 净重 温度 工作温度 防护 等级 防护等级
防水 调光 可调光 类型 转速 扭矩 转矩 空载 起订量 最小 放电 最大 持续 电芯 化学 体系 包装 方式 产地 交期 质保 外壳 材质 型号
纸箱 彩盒 广东 深圳 浙江 宁波 江苏 苏州 现货 铝合金 厂家 直销 批发 工业级 高品质 路由器 监控 通用 定制
""".split()


def lexicon_words(run: str, lexicon: frozenset[str], longest: int) -> list[str]:
    """Tokens of one run."""
    out, at = [], 0
    while at < len(run):
        size = next((n for n in range(min(longest, len(run) - at), 1, -1) if run[at : at + n] in lexicon), 1)
        word = run[at : at + size]
        for n in (2, 3):
            if size > n:
                out += [word[i : i + n] for i in range(size - n + 1) if word[i : i + n] in lexicon]
        out.append(word)
        at += size
    return out


def default_segmenter(run: str) -> list[str]:
    return lexicon_words(run, frozenset(LEXICON), max(map(len, LEXICON)))


def segmented(tokens: Column, segmenter: Callable[[str], list[str]] | None = None) -> Column:
    """Replaces each token that is a Chinese run by its words."""
    words = segmenter or default_segmenter

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept: dict[str, list[str]] = {}

        def parts(token: str) -> list[str]:
            if not "一" <= token[0] <= "鿿":
                return [token]
            if token not in kept:
                if len(kept) > 50_000:
                    kept.clear()
                kept[token] = [w for w in words(token) if w.strip()]
            return kept[token]

        for batch in batches:
            yield pa.array([None if row is None else [w for t in row for w in parts(t)] for row in batch.to_pylist()], pa.list_(pa.string()))

    return run(tokens)
