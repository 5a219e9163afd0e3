import os

from pyspark.sql import SparkSession

#: Tests run on one machine, so its own folder is one that all tasks share.
FOLDER = os.path.abspath("spark-warehouse/checkpoints")


def session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("levybook-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.checkpoint.dir", FOLDER).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
