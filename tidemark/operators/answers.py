"""Model answers, which come as a table of texts, and texts for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import answers as read
from tidemark.functions.arrays import or_empty, present, texts


def answer_values(answers: DataFrame, most_confidence: float | None = 1.0) -> DataFrame:
    """answers (tx_id, agent, text) with codes, score, level, confidence (as read if there is no most) and flags."""
    text = F.col("text")
    return answers.select(
        "tx_id",
        "agent",
        read.risk_codes(text).alias("codes"),
        read.score(text).alias("score"),
        read.level(text).alias("level"),
        read.confidence(text, most=most_confidence).alias("confidence"),
        read.sanctions_flag(text).alias("sanctions_flag"),
        read.pep_flag(text).alias("pep_flag"),
    )


def apply_answers(df: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds what answers say to the detectors' columns.

    Crypto codes count if the crypto score is 25 or more; codes with PEP, and
    the status, as the answer says; document codes and score; due diligence
    codes and score (50 if none is read).  All answers of an agent to a
    transaction count: their codes in the order of the texts, the highest score,
    and the status if one says so.  One join, on tx_id; a transaction's answers are one row.
    """
    agents = ("crypto", "pep", "documents", "due_diligence")
    wide = answers.groupBy("tx_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("agent") == a, F.col("text")))).alias(f"_{a}") for a in agents))
    out = df.join(wide, "tx_id", "left").withColumns({f"_{a}": or_empty(f"_{a}") for a in agents})

    def codes(column: str) -> Column:
        return F.flatten(F.transform(column, lambda t: or_empty(read.risk_codes(t))))

    def highest(column: str, default: int) -> Column:
        return F.array_max(F.transform(column, lambda t: read.score(t, default)))

    crypto = F.filter(codes("_crypto"), lambda c: c.startswith("CRYPTO_"))
    said = F.array_distinct(F.filter(crypto, lambda c: ~F.array_contains("crypto_factors", c)))
    flag = F.exists("_pep", lambda t: F.coalesce(read.pep_flag(t), F.lit(False)))
    status = F.col("pep_status") | flag
    own = F.when(status, texts(["PEP_MATCH"])).otherwise(texts([]))
    named = F.filter(codes("_pep"), lambda c: F.contains(c, F.lit("PEP")) & ~F.array_contains("_own_pep", c))
    papers = F.filter(
        codes("_documents"), lambda c: c.startswith("TBML_") | c.startswith("DOC_") | c.startswith("INVOICE")
    )
    has_papers = F.size(or_empty("documents")) > 0
    flags = F.concat(F.lit("Document analysis flags: "), F.array_join(papers, ", "))
    return (
        out.withColumn("_own_pep", own)
        .withColumns(
            {
                "crypto_factors": F.when(F.coalesce(F.col("crypto_score") >= 25, F.lit(False)), F.concat("crypto_factors", said)).otherwise(
                    F.col("crypto_factors")
                ),
                "pep_status": status,
                "pep_factors": F.concat("_own_pep", named),
                "document_factors": F.concat("document_factors", F.when(has_papers, papers).otherwise(texts([]))),
                "document_alerts": F.concat("document_alerts", present(F.when(has_papers & (F.size(papers) > 0), flags))),
                "document_score": F.when(has_papers & (F.size("_documents") > 0), highest("_documents", 0)),
                "due_diligence_codes": codes("_due_diligence"),
                "due_diligence_score": F.when(F.size("_due_diligence") > 0, highest("_due_diligence", 50)),
            }
        )
        .drop("_crypto", "_pep", "_documents", "_due_diligence", "_own_pep")
    )


def case_contexts(tx: DataFrame, ledger: DataFrame) -> DataFrame:
    """One text per transaction that states its facts for a model: tx_id, context.

    The ledger (customer_id, ts, amount) is summed up per customer first.
    """
    history = ledger.groupBy("customer_id").agg(F.count("*").alias("_n"), F.sum("amount").alias("_total"))
    money = lambda c: F.format_number(c.cast("double"), 2)
    wallet = F.col("crypto_details")
    value = lambda c, default: F.coalesce(c.cast("string"), F.lit(default))
    lines = [
        F.concat(F.lit("Amount: "), money(F.col("amount")), F.lit(" "), F.coalesce("currency", F.lit("USD"))),
        F.concat(F.lit("Type: "), F.coalesce("transaction_type", F.lit("UNKNOWN"))),
        F.concat(F.lit("Route: "), F.coalesce("origin_country", F.lit("UNKNOWN")), F.lit(" to "), F.coalesce("destination_country", F.lit("UNKNOWN"))),
        F.when(F.size(or_empty("intermediate_countries")) > 0, F.concat(F.lit("Intermediate Countries: "), F.array_join("intermediate_countries", ", "))),
        F.concat(F.lit("Parties: "), F.when(F.size(or_empty("parties")) > 0, F.array_join("parties", ", ")).otherwise("Not specified")),
        F.when(
            wallet.isNotNull() & (F.col("transaction_type") == "CRYPTO"),
            F.concat(
                F.lit("Wallet Age: "), value(wallet["wallet_age_days"], "Unknown"), F.lit(" days; Mixer Used: "), value(wallet["mixer_used"], "false"),
                F.lit("; Cross-Chain Swaps: "), value(wallet["cross_chain_swaps"], "0"),
            ),
        ),
        F.concat(F.lit("Account Age: "), F.coalesce("account_age_days", F.lit(0)).cast("string"), F.lit(" days")),
        F.concat(F.lit("History: "), F.when(F.col("_n") > 0, F.concat(F.col("_n").cast("string"), F.lit(" transactions, total $"), money(F.col("_total"))))
                 .otherwise("No prior transaction history")),
    ]
    return tx.join(history, "customer_id", "left").select("tx_id", F.concat_ws("\n", *lines).alias("context"))
