"""Skills: normal forms, categories, semantic matches, list normalisation, stack scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Skills under their categories, with their weight and other names. A later line replaces an earlier one's names.
_SKILLS = """Programming Languages
Python|1.0|py, cpython
Java|1.0|java ee, jvm, openjdk
JavaScript|1.0|js, javascript es6, es6, es2015, ecmascript, vanilla js, vanilla javascript
TypeScript|1.0|ts, typed javascript
C++|1.0|c plus plus, cpp, c/c++, c c++, c and c++, modern c++, stl
C|0.9|c language, ansi c
C#|1.0|csharp, c sharp, c# .net, dotnet c#
Go|1.0|golang, go language, go lang
Rust|1.0|rust lang, rust language
Ruby|0.9|ruby lang, mri ruby
PHP|0.9|
Swift|1.0|apple swift
Kotlin|1.0|kotlin jvm, kotlin/jvm
Scala|1.0|
R|0.9|r language, r programming, r stats, rlang
MATLAB|0.8|matlab/octave, octave
Perl|0.7|
Haskell|0.8|haskell lang
Elixir|0.8|elixir lang
Dart|0.9|dart lang
Julia|0.8|
Lua|0.7|
Groovy|0.7|apache groovy
Shell|0.8|bash, shell script, bash script, sh, zsh, shell scripting, bash scripting, unix shell, powershell
SQL|1.0|sql queries, sql scripting, structured query language, tsql, pl/sql, plsql, pl sql, microsoft sql server, mssql, ms sql, sql server, ssms, azure sql, oracle db
HTML|0.8|hypertext markup
CSS|0.8|cascading style sheets
Assembly|0.7|asm, x86 assembly, arm assembly
Frontend
React|1.0|reactjs, react.js, react js, react hooks, react dom
Angular|1.0|angularjs, angular.js, angular 2+, angular cli
Vue.js|1.0|vue, vuejs, vuex, pinia
Next.js|1.0|nextjs, next js
Nuxt.js|0.9|nuxt, nuxtjs
Svelte|0.9|sveltejs, svelte.js, sveltekit
Tailwind CSS|0.9|tailwind, tailwindcss, tailwind.css
Bootstrap|0.8|twitter bootstrap
Sass/SCSS|0.7|sass, scss, less
Redux|0.9|redux toolkit, react redux, redux saga, redux thunk
Webpack|0.7|
Vite|0.8|vitejs, vite.js
Three.js|0.8|threejs, webgl
D3.js|0.8|d3, d3js, datadriven documents
Backend
Node.js|1.0|nodejs, node js, node, node.js server, express, expressjs, express.js, node+express, koa, koajs, fastify
Django|1.0|django rest, django rest framework, drf
Flask|1.0|flask api, flask rest, flask python
FastAPI|1.0|fast api, fastapi python, fastapi rest
Spring Boot|1.0|spring, spring mvc, spring framework, spring security, spring cloud, spring data
ASP.NET|1.0|asp.net core, asp.net mvc, .net core, dotnet core, .net 6, .net 7, .net 8, blazor
Laravel|0.9|laravel php
Ruby on Rails|0.9|rails, ror, ruby rails
NestJS|0.9|nest.js, nest js
gRPC|0.9|protocol buffers, protobuf
GraphQL|0.9|graph ql, graphql api, graphql server, apollo graphql, apollo server, hasura
REST API|0.9|rest, restful, restful api, rest apis, restful web services, rest services, http api
WebSocket|0.8|websockets, socket.io, socketio, ws
Databases
MySQL|1.0|mariadb, mysql workbench
PostgreSQL|1.0|postgres, pg, psql, postgresdb
MongoDB|1.0|mongo, mongodb atlas, mongoose
Redis|1.0|redis cache, redis cluster, redis sentinel, redis pub/sub
SQLite|0.7|
Cassandra|0.9|apache cassandra, cassandra db
DynamoDB|0.9|aws dynamodb, amazon dynamodb
Elasticsearch|1.0|elastic search, elk stack, elastic stack, opensearch
Firestore|0.8|cloud firestore, firebase firestore
Neo4j|0.8|graph database, neo4j graph
InfluxDB|0.7|
Snowflake|0.9|snowflake db, snowflake data warehouse
BigQuery|0.9|google bigquery, gcp bigquery
Cloud & DevOps
AWS|1.0|amazon web services, amazon aws, aws cloud, aws ec2, aws s3, aws lambda, aws ecs, aws eks, aws rds, aws cloudfront, aws sqs, aws sns, aws iam
GCP|1.0|google cloud, google cloud platform, gcp cloud, google kubernetes engine, gke, cloud run, cloud functions
Azure|1.0|microsoft azure, azure cloud, azure devops, azure kubernetes service, aks, azure functions
Docker|1.0|docker container, docker compose, dockerfile, docker swarm, docker hub, containerd
Kubernetes|1.0|k8s, k8, kube, kubectl, helm, kubernetes cluster, openshift, rancher, argo, argocd
Terraform|1.0|terraform iac, hashicorp terraform, tf, terragrunt
Ansible|0.9|ansible playbook, ansible roles
Jenkins|0.9|jenkins ci, jenkins pipeline, jenkinsfile
GitHub Actions|0.9|github action, gh actions, github workflow
GitLab CI/CD|0.9|gitlab ci, gitlab pipeline, gitlab runner
Prometheus|0.8|prometheus monitoring, promql
Grafana|0.8|grafana dashboard, grafana monitoring
Nginx|0.8|nginx server, nginx proxy, nginx load balancer
Kafka|1.0|apache kafka, kafka streams, kafka connect, confluent kafka, event streaming
RabbitMQ|0.8|rabbit mq, rabbitmq broker, amqp
ML / AI
TensorFlow|1.0|tf2, tf 2, tensorflow keras, tensorflow.js, tf lite
PyTorch|1.0|pytorch lightning, torch, torchvision, torchaudio
scikit-learn|1.0|sklearn, scikit learn, scikit_learn
Keras|0.9|keras api, keras model
Hugging Face|1.0|huggingface, transformers library, hf transformers, hugging face transformers, transformers
LangChain|1.0|langchain python, langchain js
Large Language Models|1.0|llm, llms, large language model
Generative AI|1.0|genai, gen ai, generative artificial intelligence
RAG (Retrieval-Augmented Generation)|1.0|rag, retrieval augmented generation, retrievalaugmented generation
MCP|0.8|model context protocol
OpenAI API|1.0|openai, gpt api, chatgpt api, openai gpt
NLP|1.0|nlp python
Computer Vision|1.0|cv, image processing, object detection, image classification, image recognition
OpenCV|0.9|cv2, opencv python, opencv4
NumPy|1.0|numpy arrays, np
Pandas|1.0|pandas dataframe, pandas python, pd
Matplotlib|0.8|matplotlib pyplot, pyplot, plt
Seaborn|0.7|
Plotly|0.8|plotly dash, plotly express
Streamlit|0.9|streamlit app, streamlit python
Jupyter|0.7|jupyter notebook, jupyter lab, ipython, colab
Data Engineering
Apache Spark|1.0|spark, pyspark, spark sql, spark streaming, databricks spark
Hadoop|0.9|apache hadoop, hdfs, mapreduce, hive, pig, apache hive
Airflow|1.0|apache airflow, airflow dag, airflow pipeline
dbt|0.9|data build tool, dbt core, dbt cloud
Flink|0.9|apache flink, flink streaming
Power BI|0.9|powerbi, power bi desktop, microsoft power bi
Tableau|0.9|tableau desktop, tableau server, tableau public
Looker|0.8|looker studio, google looker
Mobile
React Native|1.0|reactnative, react native ios, react native android, expo, expo react native
Flutter|1.0|flutter dart, flutter ios, flutter android
Android|1.0|android sdk, android development, android studio, android native, jetpack compose
iOS|1.0|ios development, ios sdk, xcode, swiftui, uikit
Testing
Jest|0.8|jest js, jest testing, jest unit tests
Pytest|0.8|pytest python, py.test
Selenium|0.8|selenium webdriver, selenium python, selenium java
Cypress|0.8|cypress.io, cypress e2e
JUnit|0.8|
Tools & Platforms
Git|1.0|git version control, git flow, gitflow, git cli
GitHub|0.9|github.com, github pages, github enterprise
Jira|0.7|atlassian jira, jira software
Linux|1.0|ubuntu, centos, debian, fedora, rhel, linux server, unix, unix/linux
Postman|0.7|postman api, postman testing
VS Code|0.5|vscode, visual studio code
Notion|0.4|
Figma|0.8|figma design, figma ui
Firebase|0.9|firebase realtime, firebase auth, google firebase
Supabase|0.8|
Stripe|0.7|stripe payments, stripe api
Agile|0.7|agile methodology, agile scrum, scrum, kanban, lean agile, safe agile
Microservices|0.9|micro services, microservice architecture, service oriented architecture, soa
ML / AI
Machine Learning|1.0|ml, machinelearning, machine learning ml, statistical learning, supervised learning, unsupervised learning
Deep Learning|1.0|dl, deeplearning, deep learning dl, neural networks, ann, dnn
Artificial Intelligence|1.0|ai, artificialintelligence, artificial intelligence ai, intelligent systems
Data Science|1.0|datascience, data analytics, ds, data scientist
Natural Language Processing|1.0|nlp, text mining, text analytics, text processing, natural language understanding, nlu
"""
#: Versions that are names of their own, with and without a space.
VERSIONS = {
    "python": "2 3", "java": "8 11 17", "typescript": "4", "ruby": "3", "php": "5 7 8", "swift": "5", "scala": "2 3", "perl": "5", "html": "5", "css": "3", "react": "16 17 18", "angular": "2 14 15 16 17",
    "vue": "2 3", "next": "13 14", "bootstrap": "4 5", "webpack": "4 5", "django": "4", "spring boot": "3", "laravel": "10", "rails": "7", "mysql": "8", "postgresql": "15", "mongodb": "6", "sqlite": "3",
    "elasticsearch": "8", "tensorflow": "2", "pytorch": "2", "apache spark": "3", "junit": "4 5",
}


def _key(text: str) -> str:
    """The same form as skill_key, of a name."""
    return " ".join(re.sub(r"[^\w\s+#./]", "", text.lower()).split())


def _catalogue() -> tuple[tuple[str, str, float, tuple[str, ...]], ...]:
    """Canonical name, category, weight and keys: the name itself, its other names, and their versions."""
    out, category = [], ""
    for line in _SKILLS.strip().splitlines():
        if "|" not in line:
            category = line
            continue
        name, weight, others = line.split("|")
        keys = [_key(x) for x in (name, *others.split(",")) if x.strip()]
        keys += [k + gap + v for k in keys for v in VERSIONS.get(k, "").split() for gap in ("", " ")]
        out.append((name, category, float(weight), tuple(dict.fromkeys(keys))))
    return tuple(out)


SKILLS = _catalogue()
#: Category by what an unknown skill contains, in order of precedence.
GUESSES = (
    ("Backend", ("framework", "library", "sdk", "api", "rest")), ("Databases", ("database", "db", "sql", "nosql", "cache")), ("Cloud & DevOps", ("cloud", "aws", "gcp", "azure", "deploy")),
    ("ML / AI", ("ml", "ai", "model", "deep", "neural", "learning")), ("Testing", ("test", "qa", "spec", "unit", "e2e")), ("Mobile", ("android", "ios", "mobile", "flutter", "native")),
)
#: Levels by the words that tell them.
LEVELS = (("Expert", "expert|advanced|senior|lead|principal|staff"), ("Proficient", "proficient|intermediate|mid|professional"), ("Beginner", "basic|beginner|junior|elementary"), ("Familiar", "familiar|exposure|working knowledge"))


def skill_key(c: Column) -> Column:
    """Lower case; letters, digits, _ + # . / and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s+#./]", ""), r"\s+", " "))


def dictionary(spark: SparkSession) -> DataFrame:
    """key, canonical, category, weight, ord: the last entry of each key, in order of first appearance."""
    last = {}
    for name, category, weight, keys in SKILLS:
        for k in keys:
            last[k] = (name, category, weight)
    return spark.createDataFrame([(k, *v, i) for i, (k, v) in enumerate(last.items())], "key string, canonical string, category string, weight double, ord int")


def level(raw: Column) -> Column:
    """Level told in brackets, else anywhere."""
    inside, out = F.lower(F.regexp_extract(raw, r"\(([^)]*)\)", 1)), F.lit(None).cast("string")
    for source in (F.lower(raw), inside):
        for name, words in reversed(LEVELS):
            out = F.when(source.rlike(rf"\b(?:{words})\b"), name).otherwise(out)
    return out


def bare(raw: Column) -> Column:
    """Without a leading category ("Languages: ") and without the level."""
    words = "|".join(w for _, w in LEVELS)
    t = F.regexp_replace(raw, r"^[A-Za-z &/]+:\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", ""), rf"(?i)\b(?:{words})\b", ""))


def guess_category(key: Column) -> Column:
    out = F.lit("Other")
    for name, parts in reversed(GUESSES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(key, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


def casing(c: Column) -> Column:
    """Short capitals and words of signs stay; else every word gets a capital first letter."""
    return F.when((F.length(c) <= 8) & (c == F.upper(c)), c).otherwise(F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " "))


def semantic_matches(keys: DataFrame, dict_: DataFrame) -> DataFrame:
    """key, canonical: for keys no entry has, the first entry that contains the key or is contained in it, with at most
    five characters of difference and a likeness 2·shorter/(sum) of 0.85 or more. Keys are distinct, entries few."""
    d = F.broadcast(dict_.select(F.col("key").alias("dkey"), "canonical", "category", "weight", "ord"))  # the fixed dictionary
    a, b = F.length("key"), F.length("dkey")
    close = (F.contains("key", F.col("dkey")) | F.contains("dkey", F.col("key"))) & (F.abs(a - b) <= 5) & (2.0 * F.least(a, b) / (a + b) >= 0.85)
    found = keys.select("key").distinct().join(d, close)
    return found.groupBy("key").agg(F.min_by(F.struct("canonical", "category", "weight"), "ord").alias("m")).select("key", "m.*")


def normalize_skills(raw: DataFrame, column: str = "raw") -> DataFrame:
    """raw with key, level, canonical, category, weight, known: dictionary, then near match, then casing and a guess."""
    d = dictionary(raw.sparkSession)
    x = raw.withColumn("level", level(F.col(column))).withColumn("__bare", bare(F.col(column))).withColumn("key", skill_key(F.col("__bare")))
    exact = x.join(F.broadcast(d.select("key", F.col("canonical").alias("c1"), F.col("category").alias("g1"), F.col("weight").alias("w1"))), "key", "left")
    near = semantic_matches(exact.filter("c1 IS NULL AND key <> ''"), d).select("key", F.col("canonical").alias("c2"), F.col("category").alias("g2"), F.col("weight").alias("w2"))
    y = exact.join(near, "key", "left")
    return y.select(
        *raw.columns, "key", "level", F.coalesce("c1", "c2", casing(F.col("__bare"))).alias("canonical"), F.coalesce("g1", "g2", guess_category(F.col("key"))).alias("category"),
        F.coalesce("w1", "w2", F.lit(0.6)).alias("weight"), (F.col("c1").isNotNull() | F.col("c2").isNotNull()).alias("known"),
    )


def skill_list(normal: DataFrame, key: str = "cand_id") -> DataFrame:
    """Each candidate's distinct skills, ranked by falling weight, then name."""
    one = normal.groupBy(key, F.lower("canonical").alias("low")).agg(F.min_by(F.struct("canonical", "category", "weight", "known"), "pos").alias("s")).select(key, "low", "s.*")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "low"))).drop("low")


def skills_by_category(ranked: DataFrame, key: str = "cand_id", most: int = 5) -> DataFrame:
    """key, category, skills: up to `most` of each category (the report's own limit), joined in rank order."""
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy(key, "category").orderBy("rank"))).filter(F.col("r") <= most)
    return top.groupBy(key, "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "canonical"))), lambda x: x["canonical"]), ", ").alias("skills"))


def stack_score(ranked: DataFrame, key: str = "cand_id") -> DataFrame:
    """min(1, 0.6·mean weight + 0.4·min(categories / 5, 1)) over known skills."""
    k = ranked.filter(F.col("known") | (F.col("weight") > 0.6)).groupBy(key).agg(F.avg("weight").alias("w"), F.count_distinct("category").alias("c"))
    return k.select(key, F.round(F.round(F.least(F.lit(1.0), F.col("w") * 0.6 + F.least(F.col("c") / 5.0, F.lit(1.0)) * 0.4), 9), 3).alias("score"))
