"""Star-schema tables written as Java sources: a program whose every declaration, call and annotation is known from a
row, so that what the reader and the resolution find can be told by SQL.

A nation is a package with books, which a ledger keeps; a supplier is a service there, wired to the ledger; a customer is a controller that knows
the books only; a
part is an entity with a repository and, if it is a small one, a test; a region is a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.tables import table

BASE = {
    "src/main/java/star/base/Named.java": "package star.base;\n\npublic interface Named {\n    String label(String key);\n}\n",
    "src/main/java/star/base/Base.java": "package star.base;\n\npublic abstract class Base {\n    protected int seen;\n    public void see() { seen++; }\n}\n",
}
BOOKS = "package star.n@n;\n\npublic interface Books@n {\n    String book(String key);\n}\n"
LEDGER = """package star.n@n;

import org.springframework.stereotype.Component;

/** Books of @name. They are kept. */
@Component
public class Ledger@n implements Books@n {
    private int rows = 0;

    @Override
    public String book(String key) { rows = rows + 1; return key; }
}
"""
SUPPLIER = """package star.n@n;

import org.springframework.kafka.annotation.KafkaListener;
import org.springframework.kafka.core.KafkaTemplate;
import org.springframework.stereotype.Service;
import org.springframework.transaction.annotation.Transactional;
import star.base.Base;
import star.base.Named;

@Service
public class Supplier@k extends Base implements Named {
    private final Ledger@n ledger;
    private KafkaTemplate<String, String> template;

    public Supplier@k(Ledger@n ledger) { this.ledger = ledger; }

    @Override
    @Transactional
    public String label(String key) { see(); return ledger.book(key); }

    @KafkaListener("supply.@n")
    public void heard(String key) {
        if (key == null) throw new IllegalStateException("none");
        template.send("heard.@k", key);
    }
}
"""
CUSTOMER = """package star.n@n.web;

import org.springframework.beans.factory.annotation.Value;
import org.springframework.security.access.prepost.PreAuthorize;
import org.springframework.web.bind.annotation.*;
import star.n@n.Books@n;

@RestController
@RequestMapping("/c@k")
public class Customer@k {
    private final Books@n books;
    @Value("${star.limit@s:10}")
    private int limit;

    public Customer@k(Books@n books) { this.books = books; }

    @GetMapping("/{id}/orders")
    @PreAuthorize("hasRole('@segment')")
    public String orders(String id) { return books.book(id); }
}
"""
PART = """package star.parts;

import jakarta.persistence.Entity;
import jakarta.persistence.Table;

@Entity
@Table(name = "part_@k")
public class Part@k {
    private String id;
    public Part@k copy() { return new Part@k(); }
}
"""
PARTS = """package star.parts;

import org.springframework.data.jpa.repository.JpaRepository;
import org.springframework.data.jpa.repository.Query;

public interface Parts@k extends JpaRepository<Part@k, String> {
    @Query("select p from Part@k p join sizes_@size s")
    Part@k find(String id);
}
"""
TEST = """package star.parts;

import org.junit.jupiter.api.Test;

class Part@kTest {
    private Part@k part;

    @Test
    void shouldCopySmallParts() { part.copy(); }
}
"""
REGION = "package star.regions;\n\npublic record Region@k(int key, String title) { }\n"


FILES_A_TASK, FEWEST_A_TASK = 50_000, 500


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the program. The rows behind the files are dealt out before they are written out as text, as the
    text is many times as large."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part")}
    main, test = "src/main/java/star/", "src/test/java/star/"
    written = (
        (t["nation"], f"{main}n@n/Books@n.java", BOOKS, {"n": "n_nationkey"}),
        (t["nation"], f"{main}n@n/Ledger@n.java", LEDGER, {"n": "n_nationkey", "name": "n_name"}),
        (t["supplier"], f"{main}n@n/Supplier@k.java", SUPPLIER, {"n": "s_nationkey", "k": "s_suppkey"}),
        (t["customer"], f"{main}n@n/web/Customer@k.java", CUSTOMER, {"n": "c_nationkey", "k": "c_custkey", "s": "c_custkey % 7", "segment": "c_mktsegment"}),
        (t["part"], f"{main}parts/Part@k.java", PART, {"k": "p_partkey"}),
        (t["part"], f"{main}parts/Parts@k.java", PARTS, {"k": "p_partkey", "size": "p_size"}),
        (t["part"].where("p_size <= 5"), f"{test}parts/Part@kTest.java", TEST, {"k": "p_partkey"}),
        (t["region"], f"{main}regions/Region@k.java", REGION, {"k": "r_regionkey"}),
    )
    names = sorted({name for *_, of in written for name in of}, key=len, reverse=True)  # longer names first, as a name may begin another
    rows, path, text = None, F.lit(None), F.lit(None)
    for i, (df, at, template, of) in enumerate(written):
        part = df.select(F.lit(i).alias("what"), *[F.expr(of.get(name, "null")).cast("string").alias(name) for name in names])
        rows = part if rows is None else rows.union(part)
        for name in names:
            if name in of:
                at, template = (F.replace(x if isinstance(x, Column) else F.lit(x), F.lit(f"@{name}"), F.col(name)) for x in (at, template))
        path, text = F.when(F.col("what") == i, at).otherwise(path), F.when(F.col("what") == i, template).otherwise(text)
    n = rows.count()
    tasks = max(1, min(64, n // FEWEST_A_TASK), -(-n // FILES_A_TASK))
    return spark.createDataFrame(list(BASE.items()), "path string, text string").union(rows.repartition(tasks).select(path.alias("path"), text.alias("text")))
